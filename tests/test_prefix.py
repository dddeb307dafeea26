import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalspan.functions.prefix import rank_values, rank_values_both, running_totals, with_both_ranks, with_rank
from vitalspan.operators.cohorts import bucketed_ranges


def values(spark, seed):
    source = random.Random(seed)
    data = [
        (source.choice("pq"), None if source.random() < 0.1 else source.choice([source.random(), 0.0, 1.0, 2.5]))
        for _ in range(400)
    ]
    return spark.createDataFrame(data, "k string, v double")


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_equal_a_global_window(spark, descending):
    df = values(spark, 1)
    order = F.col("v").desc_nulls_first() if descending else F.col("v").asc_nulls_last()
    want = df.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(order))).distinct()
    got = rank_values(df, "v", ["k"], descending, slots=7)
    assert rows(got, "k", "v", "rank") == rows(want, "k", "v", "rank")


def test_any_number_of_keys(spark):
    df = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    order = Window.partitionBy("k").orderBy(F.desc("v"))
    want = df.withColumn("rank", F.rank().over(order)).distinct()
    assert rows(rank_values(df, "v", ["k"]), "k", "v", "rank") == rows(want, "k", "v", "rank")


def test_row_ranks_keep_every_row(spark):
    df = values(spark, 2)
    want = df.withColumn("rank", F.rank().over(Window.orderBy(F.col("v").desc_nulls_first())))
    assert rows(with_rank(df, "v", slots=5), "k", "v", "rank") == rows(want, "k", "v", "rank")


def test_both_ranks_equal_two_windows(spark):
    df = values(spark, 4)
    for keys in ([], ["k"]):
        over = Window.partitionBy(*keys)
        want = df.withColumn("rank_up", F.rank().over(over.orderBy(F.col("v").asc_nulls_last())))
        want = want.withColumn("rank_down", F.rank().over(over.orderBy(F.col("v").desc_nulls_first())))
        columns = (*keys, "v", "rank_up", "rank_down")
        assert rows(rank_values_both(df, "v", keys, slots=6), *columns) == rows(want.select(*columns).distinct(), *columns)
    assert rows(with_both_ranks(df, "v"), "k", "v", "rank_up", "rank_down") == rows(
        df.withColumn("rank_up", F.rank().over(Window.orderBy(F.col("v").asc_nulls_last()))).withColumn(
            "rank_down", F.rank().over(Window.orderBy(F.col("v").desc_nulls_first()))
        ),
        *("k", "v", "rank_up", "rank_down"),
    )
    assert with_both_ranks(df.limit(0), "v").count() == 0


def test_running_totals_and_following_row(spark):
    df = values(spark, 3).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("v"))
    want = df.select(
        "v",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
        F.lead("n").over(order).alias("n_next"),
    )
    got = running_totals(df, "v", ["n"], slots=9, following=True)
    assert rows(got, "v", "n_before", "n_next") == rows(want, "v", "n_before", "n_next")


def tally(spark, pairs, cohort="Custom Reports p/ User"):
    return spark.createDataFrame(
        [(cohort, v, n, 10.0 * n, n) for v, n in pairs], "cohort string, value string, n long, score double, scored long"
    ).withColumn("value", F.col("value").cast("decimal(38,18)"))


def test_buckets_put_nulls_first_and_reach_the_last(spark):
    df = tally(spark, [("3", 1), ("1", 2), (None, 1)])
    found = bucketed_ranges(df, F.lit(4).cast("decimal(20,0)"))
    # Ranks: NULL 1, three 2, both ones 3 -> 2.5, 5 and 7.5.
    assert rows(found, "bucket", "range", "n") == [(2, None, 1), (5, "[3.000, 3.000]", 1), (7, "[1.000, 1.000]", 2)]
    over = bucketed_ranges(tally(spark, [("2", 1), ("1", 1)]), F.lit(2).cast("decimal(20,0)"))
    assert rows(over, "bucket")[-1] == (5,) or (10,) in rows(over, "bucket")
    past = bucketed_ranges(tally(spark, [("2", 3), ("1", 1)]), F.lit(2).cast("decimal(20,0)"))
    assert (20,) in rows(past, "bucket")


def test_range_text_keeps_zeros_and_rounds_halves_up(spark):
    found = bucketed_ranges(tally(spark, [("0.5", 1), ("0.1235", 1)]), F.lit(100).cast("decimal(20,0)"))
    assert rows(found, "range") == [("[0.124, 0.500]",)]
    whole = bucketed_ranges(tally(spark, [("12", 1)], "Student Count"), F.lit(100).cast("decimal(20,0)"))
    assert rows(whole, "range") == [("[12, 12]",)]
