"""Continuous-subscription tenure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.calendar import as_day, month_series
from vitalspan.session import cut_lineage

# Which subscriptions count.
PRODUCT_GROUP = "DnA"
PRODUCT_PATTERN = "%DnA%"
PRICE_PATTERNS = ("%Rate%", "%License%")
GAP_DAYS = 90


def counted_subscriptions(subscriptions: DataFrame) -> DataFrame:
    name = F.col("product_name")
    priced = name.ilike(PRICE_PATTERNS[0]) | name.ilike(PRICE_PATTERNS[1])
    return subscriptions.where((F.col("product_group") == PRODUCT_GROUP) & name.ilike(PRODUCT_PATTERN) & priced)


def earliest_starts(subscriptions: DataFrame, as_of, years_back: int = 5, gap_days: int = GAP_DAYS) -> DataFrame:
    """(account_number, account_name, earliest_start): how far back each chain reaches.

    A chain is seeded, per account and name, by the first subscription active on any
    calendar month-end. From a reached start it goes on to every older subscription of the
    account, under any name, that ended no more than ``gap_days`` before it.

    Subscriptions shrink map-side to one row per (account, name, start). A chain that comes
    down to a start goes on unless all older subscriptions ended more than ``gap_days`` before
    it, which a running maximum of ends tells; so an account of one name is dated by windows
    alone. Accounts of several names, where a name is reached only if its own end meets the
    nearest later date reached, are walked once from the latest start down. A NULL account has
    no other subscriptions, so its seeds stand.
    """
    this_month = F.trunc(as_day(as_of), "MM")
    first_end = F.last_day(F.add_months(this_month, -12 * years_back))
    last_end = F.last_day(this_month)
    # The first calendar day on or after the start decides whether it was ever active.
    opening = F.greatest(F.last_day("start_date"), first_end)
    active = (opening <= last_end) & (F.col("end_date").isNull() | (F.col("end_date") > opening))

    # An open end seeds a chain but never extends one, so MAX may skip it.
    # Written once, as the seeds, the walk and the names all read it.
    starts = cut_lineage(
        counted_subscriptions(subscriptions)
        .where(F.col("start_date").isNotNull())
        .groupBy("account_number", "account_name", "start_date")
        .agg(F.max("end_date").alias("last_end"), F.max(active).alias("active"))
    )
    seeds = (
        starts.where("active")
        .groupBy("account_number", "account_name")
        .agg(F.min("start_date").alias("start_date"))
    )
    dates = (
        starts.select("account_number", "start_date", "last_end", F.lit(False).alias("seed"))
        .unionByName(
            seeds.select(
                "account_number", "start_date", F.lit(None).cast("date").alias("last_end"), F.lit(True).alias("seed")
            )
        )
        .groupBy("account_number", "start_date")
        .agg(F.max("last_end").alias("last_end"), F.max("seed").alias("seed"))
    )
    names = starts.groupBy("account_number").agg(
        (F.count_distinct("account_name") + F.max(F.col("account_name").isNull().cast("int")) > 1).alias("several")
    )
    dates = dates.where("account_number IS NOT NULL").join(names, "account_number")

    order = Window.partitionBy("account_number").orderBy("start_date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    older_end = F.max("last_end").over(before)
    opens = older_end.isNull() | (older_end < F.date_sub("start_date", gap_days))
    chained = dates.where("NOT several").withColumn("opens", F.when(opens, F.col("start_date")))
    chained = chained.withColumn("earliest_start", F.max("opens").over(order)).where("seed")
    single = chained.join(seeds.select("account_number", "account_name"), "account_number")
    single = single.select("account_number", "account_name", "earliest_start")

    walked = dates.where("several").select("account_number", "start_date", "last_end", "seed")
    walked = walked.repartition("account_number").sortWithinPartitions("account_number", F.desc("start_date"))
    kind = starts.schema["account_number"].dataType.simpleString()
    nearest = walked.mapInArrow(_walk(gap_days), f"account_number {kind}, start_date date, low date")
    extended = (
        starts.join(nearest, ["account_number", "start_date"])
        .where(F.col("last_end") >= F.date_sub(F.col("low"), gap_days))
        .select("account_number", "account_name", "start_date")
    )
    kept = seeds.join(names.where("several").select("account_number"), "account_number", "left_semi")
    lone = seeds.where("account_number IS NULL").select("account_number", "account_name", "start_date")
    several = extended.unionByName(kept).groupBy("account_number", "account_name").agg(F.min("start_date").alias("earliest_start"))
    return single.unionByName(several).unionByName(lone.withColumnRenamed("start_date", "earliest_start"))


def _walk(gap_days: int):
    """Next to each start of an account the nearest later one that its chain has reached.

    Rows come by account, latest start first; only the last account and date are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, low = None, None
        for batch in batches:
            lows = []
            days = [batch.column(c).cast(pa.int32()).to_pylist() for c in ("start_date", "last_end")]
            for name, start, end, seed in zip(batch.column("account_number").to_pylist(), *days, batch.column("seed").to_pylist()):
                if name != account:
                    account, low = name, None
                lows.append(low)
                if seed or (low is not None and end is not None and end >= low - gap_days):
                    low = start
            columns = [batch.column("account_number"), batch.column("start_date"), pa.array(lows, pa.int32()).cast(pa.date32())]
            yield pa.RecordBatch.from_arrays(columns, names=["account_number", "start_date", "low"])

    return run


def client_tenure(subscriptions: DataFrame, as_of, years_back: int = 5, gap_days: int = GAP_DAYS) -> DataFrame:
    """Tenure in days at every calendar month-end; negative before the chain begins."""
    reached = earliest_starts(subscriptions, as_of, years_back, gap_days)
    dated = reached.withColumn("month", F.explode(month_series(as_of, years_back)))
    as_of_date = F.last_day("month")
    return dated.select(
        "account_number",
        "account_name",
        "earliest_start",
        as_of_date.alias("as_of_date"),
        F.datediff(as_of_date, "earliest_start").alias("subscriber_tenure_days"),
    )
