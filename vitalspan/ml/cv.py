"""Stratified folds, cross-validation, model sweeps and grid search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.ml.evaluate import class_metrics, roc_auc
from vitalspan.ml.models import classifier, scores
from vitalspan.ml.prep import best_features, feature_names, preparation
from vitalspan.ml.specs import ModelSpec
from vitalspan.plans.training import SPELL
from vitalspan.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 19, name: str = "fold") -> DataFrame:
    """Deal each label's rows into ``k`` folds in a seeded random order.

    The order is that of a digest of the unique key, so the digest's first characters cut
    every label into even slots without looking at the data; a slot's rows are numbered in
    its own task and start where the slots before it end.
    """
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    marked = df.withColumn("digest", digest).withColumn("slot", F.substring("digest", 1, 3))
    sizes = marked.groupBy(label, "slot").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy(label).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(label).alias("slot_label"),
        F.col("slot").alias("slot_name"),
        F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"),
    )
    place = F.row_number().over(Window.partitionBy(label, "slot").orderBy("digest", key)) - 1
    numbered = marked.withColumn("place", place)
    # 4096 slots per label at most.
    joined = numbered.join(
        F.broadcast(starts), numbered[label].eqNullSafe(F.col("slot_label")) & (F.col("slot") == F.col("slot_name"))
    )
    fold = ((F.col("start") + F.col("place")) % k).cast("int")
    return joined.select(*df.columns, fold.alias(name))


@dataclass
class CrossValidation:
    folds: DataFrame  # one row of metrics per fold
    models: list[PipelineModel]

    def mean(self) -> DataFrame:
        return self.folds.agg(*[F.avg(m).alias(m) for m in METRICS])


def _fold_rows(folded: DataFrame, spec: ModelSpec, fold: int, sampler):
    """Preparation fitted on one fold's training rows, and both encoded sides."""
    train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
    output = "encoded" if spec.select else "features"
    prepared = Pipeline(stages=preparation(spec, output)).fit(train)
    encoded = prepared.transform(train)
    return prepared, (encoded if sampler is None else sampler(encoded, output)), prepared.transform(test)


def _score_candidates(
    folded: DataFrame, candidates: Sequence[tuple[ModelSpec, float]], sampler, parallelism: int, options: dict
) -> tuple[DataFrame, dict[tuple[int, int], PipelineModel]]:
    """Fit every (candidate, fold) and gather the held-out rows' scores.

    Candidates differ in cost and weights only, so each fold is prepared and sampled once.
    """
    spec = candidates[0][0]
    with ThreadPool(parallelism) as pool:
        sides = pool.map(lambda fold: _fold_rows(folded, spec, fold, sampler), range(spec.folds))

        def fit(job: tuple[int, int]):
            number, fold = job
            chosen, cost = candidates[number]
            prepared, train, test = sides[fold]
            rest = ([best_features(chosen.select)] if chosen.select else []) + [classifier(chosen, cost, **options)]
            fitted = Pipeline(stages=rest).fit(train)
            scored = scores(fitted, test).select(
                F.lit(number).alias("candidate"), F.lit(fold).alias("fold"), "label", "score", "prediction"
            )
            return job, PipelineModel(stages=[*prepared.stages, *fitted.stages]), scored

        jobs = [(n, f) for n in range(len(candidates)) for f in range(spec.folds)]
        done = pool.map(fit, jobs)
    return cut_lineage(reduce(DataFrame.unionByName, [d[2] for d in done])), {d[0]: d[1] for d in done}


def _fold_metrics(scored: DataFrame) -> DataFrame:
    keys = ["candidate", "fold"]
    areas = roc_auc(scored, keys=keys)
    return class_metrics(scored, keys=keys).join(areas, keys).select(*keys, *METRICS)


def cross_validate(
    rows: DataFrame,
    spec: ModelSpec,
    cost: float,
    key: str = "row_id",
    seed: int = 19,
    sampler: Callable | None = None,
    parallelism: int = 8,
    **options,
) -> CrossValidation:
    """Held-out accuracy, precision, recall, F1 and ROC area per fold.

    The sampler sees training rows only. All folds' scores are measured together.
    """
    folded = cut_lineage(stratified_folds(rows, key, k=spec.folds, seed=seed))
    scored, models = _score_candidates(folded, [(spec, cost)], sampler, parallelism, options)
    folds = _fold_metrics(scored).drop("candidate")
    return CrossValidation(folds, [models[(0, fold)] for fold in range(spec.folds)])


def held_out(rows: DataFrame, spec: ModelSpec, cost: float, key: str = "row_id", seed: int = 19, parallelism: int = 8, **options) -> DataFrame:
    """(fold, label, score, prediction) of every row by the model that has not seen it, stored."""
    folded = cut_lineage(stratified_folds(rows, key, k=spec.folds, seed=seed))
    scored, _ = _score_candidates(folded, [(spec, cost)], None, parallelism, options)
    return scored.drop("candidate")


def selected_features(result: CrossValidation, spec: ModelSpec, spark) -> DataFrame:
    """(fold, feature) chosen by each fold's selection."""
    rows = [(i, name) for i, model in enumerate(result.models) for name in feature_names(model, spec)]
    return spark.createDataFrame(rows, "fold int, feature string")


def sweep(
    rows: DataFrame,
    models: dict[str, ModelSpec],
    key: str = "row_id",
    date: str | None = "start_date",
    seed: int = 19,
    sampler: Callable | None = None,
    parallelism: int = 8,
    **options,
) -> DataFrame:
    """Mean metrics of every model and cost, with and without the excluded spell.

    One line per (model, cost, filter), shaped for the evaluation log.
    """
    spark = rows.sparkSession
    lines = []
    for outside in (True, False) if date else (False,):
        kept = rows
        if outside:
            first, last = (F.lit(d).cast("date") for d in SPELL)
            kept = rows.where((F.col(date) < first) | (F.col(date) > last))
        for name, spec in models.items():
            folded = cut_lineage(
                stratified_folds(kept.select(key, "label", *spec.columns), key, k=spec.folds, seed=seed)
            )
            candidates = [(spec, cost) for cost in spec.costs]
            used = sampler if spec.undersample else None
            scored, _ = _score_candidates(folded, candidates, used, parallelism, options)
            found = _fold_metrics(scored).groupBy("candidate").agg(*[F.avg(m).alias(m) for m in METRICS])
            for line in found.collect():  # one per cost
                weights = dict(enumerate(spec.weights)) if spec.weights else None
                cost = spec.costs[line["candidate"]]
                lines.append(
                    (name, list(spec.columns), weights, *[line[m] for m in METRICS], spec.kind, outside, cost)
                )
    return spark.createDataFrame(lines, SWEEP_COLUMNS)


SWEEP_COLUMNS = (
    "model_name string, features array<string>, weights map<int,double>, accuracy double, precision double, "
    "recall double, f1 double, roc_auc double, kind string, outside_spell boolean, c double"
)


def grid_search(
    rows: DataFrame,
    spec: ModelSpec,
    costs: Sequence[float],
    weights: Sequence[tuple[float, float]],
    key: str = "row_id",
    seed: int = 19,
    parallelism: int = 8,
    **options,
) -> DataFrame:
    """Mean F1 of every cost and weighting, best first, earlier grid points ahead of equals.

    Nothing is refitted; the first row is the answer.
    """
    points = [(cost, pair) for cost in costs for pair in weights]
    candidates = [(replace(spec, weights=pair), cost) for cost, pair in points]
    folded = cut_lineage(stratified_folds(rows, key, k=spec.folds, seed=seed))
    scored, _ = _score_candidates(folded, candidates, None, parallelism, options)
    means = class_metrics(scored, keys=["candidate", "fold"]).groupBy("candidate").agg(F.avg("f1").alias("f1"))
    grid = rows.sparkSession.createDataFrame(
        [(i, float(c), float(w[0]), float(w[1])) for i, (c, w) in enumerate(points)],
        "candidate int, c double, weight_0 double, weight_1 double",
    )
    return grid.join(means, "candidate").orderBy(F.desc("f1"), "candidate")
