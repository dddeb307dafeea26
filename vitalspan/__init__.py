"""Client-health analytics as plain Spark DataFrame functions."""

from vitalspan.session import configure, cut_lineage, local_session

__all__ = ["configure", "cut_lineage", "local_session"]
