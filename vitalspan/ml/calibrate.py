"""Sigmoid calibration of decision values, averaged over folds."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.ml.cv import stratified_folds
from vitalspan.ml.models import fit_model, scores
from vitalspan.ml.specs import ModelSpec
from vitalspan.session import cut_lineage


def fit_sigmoid(scored: DataFrame, label: str = "label", score: str = "score") -> tuple[float, float]:
    """(slope, intercept) of P(1) = 1 / (1 + exp(-(slope * score + intercept))).

    Targets are softened by the class sizes. A target t enters as label 1 with weight t
    and label 0 with weight 1 - t, after rows have shrunk to one per score and label.
    """
    counted = scored.groupBy(F.col(score).alias("score"), (F.col(label) == 1).alias("positive")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = {r["positive"]: r["n"] for r in counted.groupBy("positive").agg(F.sum("n").alias("n")).collect()}
    high = (sizes.get(True, 0) + 1.0) / (sizes.get(True, 0) + 2.0)
    low = 1.0 / (sizes.get(False, 0) + 2.0)
    target = F.when(F.col("positive"), F.lit(high)).otherwise(F.lit(low))
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * target).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - target)).alias("weight")),
    )
    rows = counted.select(array_to_vector(F.array("score")).alias("features"), F.explode(sides).alias("side")).select(
        "features", "side.label", "side.weight"
    )
    model = LogisticRegression(weightCol="weight", regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


@dataclass
class CalibratedEnsemble:
    """Fold models with their sigmoids; the probability is the members' mean."""

    members: list[tuple[PipelineModel, float, float]]

    def transform(self, rows: DataFrame) -> DataFrame:
        columns = list(rows.columns)
        out = rows
        for i, (model, slope, intercept) in enumerate(self.members):
            value = 1 / (1 + F.exp(-(F.col("score") * slope + intercept)))
            out = scores(model, out).select(*columns, value.alias(f"p{i}"))
            columns.append(f"p{i}")
        mean = sum((F.col(f"p{i}") for i in range(1, len(self.members))), F.col("p0")) / len(self.members)
        return out.withColumn("probability_1", mean).select(*rows.columns, "probability_1")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (model, _, _) in enumerate(self.members):
            model.write().overwrite().save(f"{path}/member-{i}")
        lines = [(i, slope, intercept) for i, (_, slope, intercept) in enumerate(self.members)]
        table = spark.createDataFrame(lines, "member int, slope double, intercept double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/sigmoids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CalibratedEnsemble:
        lines = spark.read.parquet(f"{path}/sigmoids").orderBy("member").collect()  # one per fold
        return CalibratedEnsemble(
            [(PipelineModel.load(f"{path}/member-{r['member']}"), r["slope"], r["intercept"]) for r in lines]
        )


def calibrate(
    rows: DataFrame,
    spec: ModelSpec,
    cost: float,
    key: str = "row_id",
    folds: int = 5,
    seed: int = 19,
    parallelism: int = 8,
    **options,
) -> CalibratedEnsemble:
    """Fit on all folds but one, fit the sigmoid on the one left out, for each fold."""
    folded = cut_lineage(stratified_folds(rows, key, k=folds, seed=seed))

    def member(fold: int) -> tuple[PipelineModel, float, float]:
        model = fit_model(folded.where(F.col("fold") != fold), spec, cost, **options)
        held = scores(model, folded.where(F.col("fold") == fold)).select("label", "score")
        return (model, *fit_sigmoid(held))

    with ThreadPool(parallelism) as pool:
        return CalibratedEnsemble(pool.map(member, range(folds)))
