"""Mixing sources to target weights by Poisson replication.

A source with target rate r gives each of its documents a Poisson number of copies with mean
r, read off by inverting the distribution at a number hashed from the seed and the document.
No document needs to know of another: the one shuffle is the one that puts copies in their
global random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "mix-1"
#: Sources whose rates may be broadcast; more sources go through a shuffle join.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, scale: float = 1.0, source: str = "source") -> DataFrame:
    """(source, rate): the mean number of copies of a document of each source.

    The target share of a source is its weight in ``weights`` (source, weight) over the sum of
    weights, or by default its document count to ``power`` over the sum of such powers. The
    whole mixture has ``scale`` times the documents there are. Sources without a positive
    weight get the rate 0. A NULL source is a source.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").alias("weight"))
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("named")), "left")
        weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(0.0)
        counts = counts.select("source", "n", weight.cast("double").alias("weight"))
    every = Window.partitionBy()
    rate = F.lit(scale) * F.sum("n").over(every) * F.col("weight") / F.sum("weight").over(every) / F.col("n")
    return counts.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until nothing a 52-bit number could tell is left.

    Beyond ``rate + 12 sqrt(rate) + 40`` less than 2**-53 of the distribution remains. Terms
    are taken from their logarithms, so a high rate does not vanish.
    """
    ks = F.sequence(F.lit(0), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    # Partial sums of log k, then of the terms.
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def add(state: Column, k: Column) -> Column:
        log = state["log"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
        total = state["sum"] + F.exp(k * F.log(rate) - rate - log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(state["all"], total).alias("all"))

    steps = F.aggregate(ks, start, add, lambda state: state["all"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", into: str = "copy", key: str = "shuffle_key") -> DataFrame:
    """Copies of ``docs`` in a global random order: its columns, ``into`` and ``key``.

    A document of rate r appears X times, X the Poisson(r) quantile at ``uniform(seed,
    doc_id)``; ``into`` numbers its copies from 1 and ``key`` is the digest that orders the
    result. Rows with one doc_id, repeated rows among them, get the same count each; a NULL
    doc_id counts as the empty string; texts are not looked at. Columns named like ``into`` or
    ``key`` are replaced. Sources without a rate are left out; no documents give none.
    """
    columns = [c for c in docs.columns if c not in (into, key)]
    taken = "_" * (1 + max(map(len, docs.columns)))
    steps = rates.groupBy(F.col("source").alias(taken + "s")).agg(F.max("rate").alias("rate"))
    steps = steps.select(taken + "s", poisson_steps(F.col("rate")).alias(taken + "p"))
    if steps.count() <= BROADCAST_SOURCES:
        steps = F.broadcast(steps)
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    joined = docs.select(*columns).join(steps, F.col(source).eqNullSafe(F.col(taken + "s")))
    u = uniform(F.lit(seed), name)
    times = F.size(F.filter(F.col(taken + "p"), lambda p: p <= F.col(taken + "u")))
    copies = joined.withColumn(taken + "u", u).withColumn(taken + "n", times).where(F.col(taken + "n") > 0)
    copies = copies.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(taken + "n").cast("long"))).alias(into))
    order = F.md5(F.concat_ws(":", F.lit(seed), name, F.col(into).cast("string")))
    return copies.withColumn(key, order).repartitionByRange(key).sortWithinPartitions(key)
