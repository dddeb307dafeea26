"""Exact running totals and ranks over a global order, without a one-task window.

The input holds one row per (keys, value). One range shuffle by keys and value deals rows to
slots, the partition each row is in; slot totals give each slot its starting sum, and a window
inside the slot does the rest. The dealt rows are written once, so every later pass and every
retried task sees the same slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.session import cut_lineage


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = True,
    slots: int | None = None,
    following: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Add ``<sum>_before``: the total of each sum over rows strictly ahead in the order.

    NULL values come first when descending and last when ascending; there may be any number
    of ``keys``. ``slots`` is the number of partitions, by default that of shuffles. With
    ``following``, ``<sum>_next`` is the sum held by the next row in the order, NULL on the
    last one. With ``whole``, ``<sum>_all`` is the total of all rows of the keys.
    """
    slots = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_last()
    outermost = F.max_by if descending else F.min_by
    placed = df.repartitionByRange(slots, *[F.col(k).asc_nulls_first() for k in keys], order)
    slotted = cut_lineage(placed.withColumn("slot", F.spark_partition_id()))

    totals = [F.sum(s).alias(f"{s}_slot") for s in sums]
    if following:
        opening = F.struct(*[F.col(s).alias(s) for s in sums])
        # A NULL opens a slot only where it is the slot's one value.
        totals.append(F.coalesce(outermost(opening, F.col(value)), F.max(opening)).alias("opening"))
    across = Window.partitionBy(*keys).orderBy("slot")
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    heads = slotted.groupBy(*keys, "slot").agg(*totals)
    picks = [F.coalesce(F.sum(f"{s}_slot").over(ahead), F.lit(0)).alias(f"{s}_head") for s in sums]
    if following:
        picks.append(F.lead("opening").over(across).alias("opening"))
    if whole:
        picks += [F.sum(f"{s}_slot").over(Window.partitionBy(*keys)).alias(f"{s}_all") for s in sums]
    heads = heads.select(*keys, "slot", *picks)

    inside = Window.partitionBy(*keys, "slot").orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = slotted
    for s in sums:
        local = local.withColumn(f"{s}_in", F.coalesce(F.sum(s).over(before), F.lit(0)))
        if following:
            local = local.withColumn(f"{s}_after", F.lead(s).over(inside))

    if keys:
        on = [local[k].eqNullSafe(heads[k]) for k in keys] + [local["slot"] == heads["slot"]]
    else:
        on = [local["slot"] == heads["slot"]]
    joined = local.join(heads, on, "left")
    out = [local[c] for c in df.columns]
    out += [(local[f"{s}_in"] + heads[f"{s}_head"]).alias(f"{s}_before") for s in sums]
    if following:
        out += [F.coalesce(local[f"{s}_after"], heads["opening"][s]).alias(f"{s}_next") for s in sums]
    if whole:
        out += [heads[f"{s}_all"] for s in sums]
    return joined.select(*out)


def rank_values(
    df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = True, slots: int | None = None
) -> DataFrame:
    """``rank()`` of every distinct (keys, value), with its row count ``n``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, value, ["n"], keys, descending, slots)
    return ranked.select(*keys, value, "n", (F.col("n_before") + 1).alias("rank"))


def with_rank(
    df: DataFrame, value: str, name: str = "rank", descending: bool = True, slots: int | None = None
) -> DataFrame:
    """Row-level ``rank()`` over the whole frame, joined back from the distinct values."""
    ranks = rank_values(df, value, (), descending, slots).select(
        F.col(value).alias("ranked_value"), F.col("rank").alias(name)
    )
    return df.join(ranks, df[value].eqNullSafe(ranks["ranked_value"]), "left").drop("ranked_value")


def rank_values_both(df: DataFrame, value: str, keys: Sequence[str] = (), slots: int | None = None) -> DataFrame:
    """``rank()`` of every distinct (keys, value) up, NULL last, and down, NULL first.

    The two orders are each other's reverse, so the rank down follows from the total, the rows
    ahead and the value's own rows: one range shuffle serves both.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    up = running_totals(counted, value, ["n"], keys, descending=False, slots=slots, whole=True)
    down = F.col("n_all") - F.col("n_before") - F.col("n") + 1
    return up.select(*keys, value, "n", (F.col("n_before") + 1).alias("rank_up"), down.alias("rank_down"))


def with_both_ranks(df: DataFrame, value: str, up: str = "rank_up", down: str = "rank_down", slots: int | None = None) -> DataFrame:
    """Row-level ranks in both directions, from one order of the distinct values."""
    ranks = rank_values_both(df, value, (), slots).select(
        F.col(value).alias("ranked_value"), F.col("rank_up").alias(up), F.col("rank_down").alias(down)
    )
    return df.join(ranks, df[value].eqNullSafe(ranks["ranked_value"]), "left").drop("ranked_value")
