"""Monthly usage panel: scrubbing, lags, the forward window and the change flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.bands import band_code, change_order, change_outcome

# Months when schools are mostly out of session.
OFF_MONTHS = (6, 7, 8, 12)
# Rows to look back; eight in-season rows make a year.
LAGS = (1, 4, 5, 6, 7, 8)
YEAR_LAG = 8

BAND = "atd_client_health_score_band"
SCORE = "atd_client_health_score"


def _in_season(off_months: Sequence[int]):
    return ~F.month("start_date").isin(*off_months)


def scrub_usage(usage: DataFrame, off_months: Sequence[int] = OFF_MONTHS, users_above: int | None = None) -> DataFrame:
    """Drop off-season months and rows without a database; optionally need active users."""
    kept = usage.where(_in_season(off_months) & F.col("atd_database").isNotNull())
    return kept if users_above is None else kept.where(F.col("atd_users_count") > users_above)


def scrub_monthly_usage(monthly: DataFrame, off_months: Sequence[int] = OFF_MONTHS) -> DataFrame:
    """Keep the month-typed, in-season rows that name an account."""
    return monthly.where((F.col("date_range_type") == "month") & _in_season(off_months) & F.col("sf_an").isNotNull())


def lag_label(steps: int) -> str:
    return "1year" if steps == YEAR_LAG else str(steps)


def _lag_columns(steps: int, day, band, score) -> list:
    label = lag_label(steps)
    return [
        day.alias(f"hs_{label}_lag_date"),
        band.alias(f"hs_{label}_lag_band"),
        score.alias(f"hs_{label}_lag"),
    ]


def health_lags(usage: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Date, band and score N rows back per account; ties in a month go by database.

    The work is cut by (account, month), so no account is one task: each month hands on its
    last rows only, and a month's rows look back into what the months before it handed on.
    """
    reach = max(lags)
    month = Window.partitionBy("sf_an", "start_date")
    ordered = month.orderBy("atd_database")
    row = F.struct("start_date", F.col(BAND).alias("band"), F.col(SCORE).alias("score"))
    placed = usage.select("sf_an", "start_date", "atd_database", row.alias("row")).select(
        "sf_an",
        "start_date",
        "row",
        F.row_number().over(ordered).alias("place"),
        F.count(F.lit(1)).over(month).alias("size"),
        *[F.lag("row", steps).over(ordered).alias(f"near_{steps}") for steps in lags],
    )
    tails = (
        placed.where(F.col("size") - F.col("place") < reach)
        .groupBy("sf_an", "start_date")
        .agg(F.sort_array(F.collect_list(F.struct("place", "row"))).alias("tail"))
    )
    earlier = Window.partitionBy("sf_an").orderBy("start_date").rowsBetween(-reach, -1)
    handed = tails.select(
        F.col("sf_an").alias("account"),
        F.col("start_date").alias("month"),
        F.flatten(F.collect_list(F.col("tail.row")).over(earlier)).alias("handed"),
    )
    joined = placed.join(
        handed, placed["sf_an"].eqNullSafe(handed["account"]) & (placed["start_date"] == handed["month"]), "left"
    )
    out = [placed["sf_an"], placed["start_date"]]
    for steps in lags:
        index = F.size("handed") - 1 - (F.lit(steps) - F.col("place"))
        found = F.when(F.col("place") > steps, F.col(f"near_{steps}")).otherwise(F.get("handed", index))
        out += _lag_columns(steps, found["start_date"], found["band"], found["score"])
    return joined.select(*out)


CELL = ["sf_an", "atd_database", SCORE, BAND, "start_date"]


def forward_band_range(usage: DataFrame, horizon_months: int = 3, month_starts: bool = True) -> DataFrame:
    """Lowest and highest band code of the same database in the months that follow.

    Codes are first reduced to one row per (database, date), so a database's window holds
    as many rows as it has dates. With ``month_starts`` a range frame over the month number
    finds them; other dates use a join on (database, month) that spreads each date over the
    months its horizon touches.
    """
    code = band_code(F.col(BAND))
    # Partitioned as the join back needs, which also serves the deduplication: one shuffle.
    cells = usage.select(*CELL).repartition("atd_database", "start_date").distinct()
    dated = usage.groupBy("atd_database", "start_date").agg(F.min(code).alias("low"), F.max(code).alias("high"))
    number = F.year("start_date") * 12 + F.month("start_date")
    if month_starts:
        ahead = Window.partitionBy("atd_database").orderBy(number).rangeBetween(1, horizon_months)
        later = dated.select(
            "atd_database",
            "start_date",
            F.min("low").over(ahead).alias("interval_min_band_number"),
            F.max("high").over(ahead).alias("interval_max_band_number"),
        )
    else:
        asks = dated.select(
            "atd_database",
            F.col("start_date").alias("asked"),
            F.explode(F.sequence(number, number + horizon_months)).alias("month_number"),
        )
        holds = dated.withColumn("month_number", number)
        within = (F.col("start_date") > F.col("asked")) & (
            F.col("start_date") <= F.add_months("asked", horizon_months)
        )
        later = (
            asks.join(holds, ["atd_database", "month_number"])
            .where(within)
            .groupBy("atd_database", F.col("asked").alias("start_date"))
            .agg(F.min("low").alias("interval_min_band_number"), F.max("high").alias("interval_max_band_number"))
        )
    return cells.join(later, ["atd_database", "start_date"], "left").select(
        "sf_an",
        "atd_database",
        F.col(BAND).alias("hs_band"),
        code.alias("band_number"),
        "start_date",
        "interval_min_band_number",
        "interval_max_band_number",
    )


def flag_change(ranged: DataFrame) -> DataFrame:
    """Add whether, and how, the band crossed the healthy line within the horizon."""
    code, low, high = F.col("band_number"), F.col("interval_min_band_number"), F.col("interval_max_band_number")
    return ranged.withColumns(
        {
            "hs_did_change": change_outcome(code, low, high, (False, True), (False, True)),
            "hs_change_type": change_outcome(
                code,
                low,
                high,
                (F.lit("Stayed Green"), F.lit("Green to Red/Yellow")),
                (F.lit("Stayed Red/Yellow"), F.lit("Red/Yellow to Green")),
            ),
        }
    )


def health_change(usage: DataFrame, horizon_months: int = 3) -> DataFrame:
    """Change flag per row of a scrubbed panel, with the report order of the change type."""
    flagged = flag_change(forward_band_range(usage, horizon_months))
    return flagged.withColumn("change_type_order", change_order(F.col("hs_change_type")))


def manager_vs_computed(usage: DataFrame) -> DataFrame:
    """The manager's own health rating beside the computed band."""
    return scrub_usage(usage).select("start_date", "atd_database", "csm_health", BAND)
