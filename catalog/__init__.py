"""Registered queries: adapters over the driver tables, the queries and their oracle SQL."""
