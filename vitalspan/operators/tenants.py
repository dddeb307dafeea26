"""Tenant databases: which to read, and the account each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fragments that mark a database as not a live client, case-sensitive.
SANDBOX = "sandbox"
SYSTEM_DATABASE = "postgres"
DENIED_FRAGMENTS = (
    "template",
    "portal",
    "demo",
    "jasper",
    "job_queue",
    "client",
    "sqlboss",
    "instance",
    "lightster",
    "infinitecampus",
    "specialist",
    "skyward",
    "importtest",
    "datatraining",
    "postgres",
    "csm",
    "trainingwheels",
    "_backup",
    "_iris",
    "_ise",
    "_testing",
    "_candidate",
    "mwtest",
    "staging",
    "_old",
)
DENIED_PREFIX = "_"

# The setting that holds a client's account number, and the text without one.
ACCOUNT_SETTING = "salesforce.account_number"
NO_ACCOUNT = "none"


def is_live_tenant(db: Column) -> Column:
    pattern = "|".join([f"^{SYSTEM_DATABASE}$", f"^{DENIED_PREFIX}", *DENIED_FRAGMENTS])
    return ~db.rlike(pattern)


def list_databases(directory: DataFrame) -> DataFrame:
    """(server, db) without sandboxes."""
    return directory.where(~F.col("db").contains(SANDBOX))


def pending_tenants(directory: DataFrame, done: DataFrame) -> DataFrame:
    """Live tenants that have no output yet; ``done`` holds exact names in ``client``."""
    live = list_databases(directory).where(is_live_tenant(F.col("db")))
    return live.join(done.select(F.col("client").alias("db")), "db", "left_anti").select("server", "db")


def row_ledger(tenants: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows delivered per tenant, 0 for a tenant that delivered none."""
    counted = rows.groupBy("client").agg(F.count(F.lit(1)).alias("found"))
    return tenants.join(counted, "client", "left").select(
        "client", F.coalesce("found", F.lit(0)).cast("long").alias("row_count")
    )


def tenant_accounts(clients: DataFrame, definitions: DataFrame, entries: DataFrame, strip: bool = True) -> DataFrame:
    """(client, sf_an): the configured account number of every client, else ``none``.

    The setting's name matches without case, and ``_`` stands for any character. A client
    with two matching settings or entries is an error, as one value was asked for.
    """
    key = definitions.where(F.col("key").ilike(ACCOUNT_SETTING))
    values = key.join(entries, ["client", "definition_id"], "left").select(
        "client", F.col("value").cast("string").alias("value")
    )
    checked = values.groupBy("client").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one account setting for a client")))
        .otherwise(F.first("value"))
        .alias("value")
    )
    account = F.coalesce(F.col("value"), F.lit(NO_ACCOUNT))
    if strip:
        account = F.translate(account, "{}", "")
    return clients.select("client").join(checked, "client", "left").select("client", account.alias("sf_an"))
