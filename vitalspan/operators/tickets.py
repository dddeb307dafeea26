"""Support-ticket counts on the usage panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticket_rollup(tickets: DataFrame, orgs: DataFrame, usage: DataFrame) -> DataFrame:
    """Tickets per (account, organisation name, month) for every usage month, 0 where none.

    Tickets shrink to (organisation, month) before any join. A usage month present in
    several databases counts its tickets once per database row, as a row join would.
    """
    monthly = tickets.groupBy("org_id", F.to_date(F.trunc("created_at", "MM")).alias("start_date")).agg(
        F.count("ticket_id").alias("tickets")
    )
    named = orgs.where(F.col("ie_salesforce_id").isNotNull() & (F.col("ie_salesforce_id") != ""))
    by_account = (
        monthly.join(named, "org_id")
        .groupBy(F.col("ie_salesforce_id").alias("sf_an"), "name", "start_date")
        .agg(F.sum("tickets").alias("tickets"))
    )
    months = usage.groupBy("sf_an", "start_date").agg(F.count(F.lit(1)).alias("copies"))
    count = F.coalesce(F.col("tickets") * F.col("copies"), F.lit(0)).cast("long")
    return months.join(by_account, ["sf_an", "start_date"], "left").select(
        "sf_an", "name", count.alias("ticket_count"), "start_date"
    )
