"""Classifier evaluation from (label, prediction) and (label, score) rows.

Rows shrink to counts per (keys, score) before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.prefix import running_totals


def label_at(score: Column, threshold, inclusive: bool = True) -> Column:
    """1 at or above the threshold, or only above it."""
    return (score >= threshold if inclusive else score > threshold).cast("int")


def _ratio(top: Column, bottom: Column) -> Column:
    """A ratio that is 0 where undefined."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def _metrics() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def class_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = (), places: int | None = None
) -> DataFrame:
    """Counts and accuracy, precision, recall and F1 of the positive class, in one aggregate."""
    positive, said = F.col(label) == 1, F.col(prediction) == 1
    cells = {"tp": positive & said, "fp": ~positive & said, "fn": positive & ~said, "tn": ~positive & ~said}
    counts = df.groupBy(*keys).agg(*[F.count_if(test).alias(name) for name, test in cells.items()])
    shown = {n: (m if places is None else F.round(m, places)) for n, m in _metrics().items()}
    return counts.select(*keys, *cells, *[m.alias(n) for n, m in shown.items()])


def _by_score(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    positive = F.col(label) == 1
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (), slots: int | None = None
) -> DataFrame:
    """Area under the ROC curve per key, tied scores counting half; NULL with one class only."""
    ordered = running_totals(_by_score(df, label, score, keys), "score", ["pos"], keys, slots=slots)
    won = F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0)
    sums = ordered.groupBy(*keys).agg(
        F.sum(won.cast("double")).alias("won"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
    )
    return sums.select(*keys, (F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("roc_auc"))


def roc_points(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    drop_intermediate: bool = True,
    slots: int | None = None,
) -> DataFrame:
    """(fpr, tpr, threshold) from the highest score down, opened by (0, 0) without a threshold.

    With ``drop_intermediate`` points on a straight line between their neighbours go: those
    whose next score adds as many positives and negatives as they did themselves.
    """
    ordered = running_totals(_by_score(df, label, score, ()), "score", ["pos", "neg"], slots=slots, following=True)
    if drop_intermediate:
        first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
        last = F.col("pos_next").isNull()
        bends = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
        kept = ordered.where(first | last | bends)
    else:
        kept = ordered
    counts = df.agg(
        F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) != 1).cast("double").alias("n")
    ).first()
    positives, negatives = counts["p"] or None, counts["n"] or None
    points = kept.select(
        ((F.col("neg_before") + F.col("neg")) / F.lit(negatives)).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / F.lit(positives)).alias("tpr"),
        F.col("score").cast("double").alias("threshold"),
    )
    opening = df.sparkSession.createDataFrame([(0.0, 0.0, None)], "fpr double, tpr double, threshold double")
    return opening.unionByName(points)


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", steps: int = 100) -> DataFrame:
    """Counts and metrics of ``score >= i / steps`` for i = 0 .. steps - 1.

    One pass: a row goes to the last threshold it reaches, and counts add up from above.
    Thresholds are the doubles ``i * (1 / steps)``, against which the first guess is settled.
    """
    value = F.col(score).cast("double")
    step = F.lit(1.0 / steps)
    guess = F.floor(value * steps)
    reached = (
        F.when((guess + 1) * step <= value, guess + 1).when(guess * step > value, guess - 1).otherwise(guess).cast("int")
    )
    bin_of = F.least(F.greatest(reached, F.lit(-1)), F.lit(steps - 1))
    positive = F.col(label) == 1
    counted = df.groupBy(bin_of.alias("bin")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    bins = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("bin"))
    filled = bins.join(counted, "bin", "left").na.fill(0, ["pos", "neg"])  # steps + 1 rows
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = filled.select(
        "bin",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("tn"),
    )
    return cells.where(F.col("bin") >= 0).select(
        (F.col("bin") * step).alias("threshold"), "tp", "fp", "fn", "tn", *[m.alias(n) for n, m in _metrics().items()]
    )


def best_threshold(sweep: DataFrame, by: str = "f1") -> DataFrame:
    """The sweep's best row, the lowest threshold among equals."""
    return sweep.orderBy(F.desc(by), F.asc("threshold")).limit(1)


def tuned_metrics(df: DataFrame, threshold: float, label: str = "label", score: str = "score", places: int = 4) -> DataFrame:
    """Metrics and hard-label AUC of ``score > threshold``, rounded."""
    said = df.select(F.col(label).alias("label"), label_at(F.col(score), threshold, inclusive=False).alias("prediction"))
    metrics = class_metrics(said, places=places)
    rate = (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))) - (
        F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0))
    )
    return metrics.withColumn("roc_auc", F.round((rate + 1) / 2, places))


def reliability_curve(
    df: DataFrame, label: str = "label", score: str = "score", bins: int = 10, normalize: bool = False
) -> DataFrame:
    """Share of positives and mean score per uniform bin, closed on the left; empty bins are absent.

    ``normalize`` first maps the scores linearly onto 0 .. 1, for decision values.
    """
    value = F.col(score).cast("double")
    if normalize:
        low = df.agg(F.min(value)).scalar()
        high = df.agg(F.max(value)).scalar()
        value = (value - low) / (high - low)
    rows = df.select(F.col(label).cast("double").alias("label"), value.alias("score"))
    bin_of = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_of.alias("bin")).agg(
        F.avg("label").alias("fraction_positive"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")
    )
