"""Decile cohorts: how health varies with one measure at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.prefix import running_totals
from vitalspan.operators.usage import SCORE

# Cohort name -> (source, measure, divided by users?).
COHORTS = {
    "Custom Reports p/ User": ("usage", "user_created_custom_reports", True),
    "Summary Asmts p/ User": ("monthly", "summary_asmt_created", True),
    "Student Count": ("usage", "atd_student_count", False),
    "ZD Tickets p/ User": ("tickets", "ticket_count", True),
    "Flex Asmts Created p/ User": ("usage", "asmt_created_flex", True),
    "Flex Asmts Administered p/ User": ("usage", "asmt_admin_flex", True),
    "IB Asmts Created p/ User": ("usage", "asmt_created_ib", True),
    "IB Asmts Administered p/ User": ("usage", "asmt_admin_ib", True),
    "Flex Asmts Created Score": ("usage", "asmt_created_flex_score", False),
    "Flex Asmts Administered Score": ("usage", "asmt_admin_flex_score", False),
    "IB Asmts Created Score": ("usage", "asmt_created_ib_score", False),
    "IB Asmts Administered Score": ("usage", "asmt_admin_ib_score", False),
}
WHOLE_NUMBERS = ("Student Count",)
NUMBER = "decimal(38,18)"


def _measure(name: str, per_user: bool) -> Column:
    if not per_user:
        return F.col(name).cast(NUMBER)
    return (F.col(name).cast("decimal(20,0)") / F.col("atd_users_count").cast("decimal(20,0)")).cast(NUMBER)


def _tally(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (cohort, value): rows, summed score and scored rows, combined map-side."""
    pairs = [
        F.struct(F.lit(name).alias("cohort"), _measure(*COHORTS[name][1:]).alias("value")) for name in names
    ]
    long = rows.select(F.explode(F.array(*pairs)).alias("pair"), F.col(SCORE).alias("score"))
    return long.groupBy("pair.cohort", "pair.value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.count("score").alias("scored")
    )


def bucketed_ranges(tally: DataFrame, row_count: Column, buckets: int = 10, slots: int | None = None) -> DataFrame:
    """Cut ranked values into buckets and describe each.

    The bucket is ``floor(rank / row_count * buckets)`` of the descending rank, NULL values
    ranked first, computed in whole numbers. ``row_count`` is the panel's size even where a
    cohort ranks joined rows, so its last bucket may stop short of ``buckets`` or pass it.
    """
    ranked = running_totals(tally, "value", ["n"], ["cohort"], slots=slots)
    rank = F.col("n_before") + 1
    grouped = (
        ranked.withColumn("bucket", F.floor((rank * buckets).cast("decimal(38,0)") / row_count).cast("long"))
        .groupBy("cohort", "bucket")
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            (F.sum("score") / F.nullif(F.sum("scored"), F.lit(0))).alias("avg_hs"),
            F.sum("n").alias("n"),
        )
    )
    whole = F.col("cohort").isin(*WHOLE_NUMBERS)

    def text(bound: str) -> Column:
        return F.when(whole, F.round(bound, 0).cast("string")).otherwise(F.round(bound, 3).cast("string"))

    spread = F.concat(F.lit("["), text("low"), F.lit(", "), text("high"), F.lit("]"))
    return grouped.select("cohort", "bucket", spread.alias("range"), "avg_hs", "n")


def cohort_buckets(
    usage: DataFrame,
    monthly: DataFrame | None = None,
    tickets: DataFrame | None = None,
    names: Sequence[str] = tuple(COHORTS),
    buckets: int = 10,
    slots: int | None = None,
) -> DataFrame:
    """Buckets of the named cohorts over scrubbed frames (users > 0).

    The measures of the panel itself share one scan. Those of the monthly table and of the
    ticket counts rank rows joined on (account, month), duplicates included.
    """
    parts = []
    own = [n for n in names if COHORTS[n][0] == "usage"]
    if own:
        parts.append(_tally(usage, own))
    for source, other in (("monthly", monthly), ("tickets", tickets)):
        joined = [n for n in names if COHORTS[n][0] == source]
        if joined:
            measures = [COHORTS[n][1] for n in joined]
            side = other.select("sf_an", "start_date", *measures)
            base = usage.select("sf_an", "start_date", "atd_users_count", SCORE)
            parts.append(_tally(base.join(side, ["sf_an", "start_date"]), joined))
    tally = parts[0]
    for part in parts[1:]:
        tally = tally.unionByName(part)
    row_count = usage.agg(F.count(F.lit(1)).cast("decimal(20,0)")).scalar()
    return bucketed_ranges(tally, row_count, buckets, slots)


def cohort_report(
    usage: DataFrame,
    monthly: DataFrame,
    tickets: DataFrame,
    names: Sequence[str] = tuple(COHORTS),
    buckets: int = 10,
    slots: int | None = None,
) -> DataFrame:
    """All cohorts' buckets, each with its cohort's total row count."""
    found = cohort_buckets(usage, monthly, tickets, names, buckets, slots)
    return found.withColumn("total_n", F.sum("n").over(Window.partitionBy("cohort")))
