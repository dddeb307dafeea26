"""Feature preparation as ``pyspark.ml`` stages that save and load with a pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    UnivariateFeatureSelector,
    UnivariateFeatureSelectorModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.ml.specs import ModelSpec


class PopulationScaler(Estimator, HasInputCols, HasOutputCols):
    """Mean 0 and population deviation 1 per column; a constant column becomes 0.

    One aggregate over all columns; the fitted stage is a projection of literals.
    """

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        columns = self.getInputCols()
        wanted = [f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in MOMENTS]
        found = dataset.agg(*wanted).first()
        scaled = []
        for i, (column, out) in enumerate(zip(columns, self.getOutputCols(), strict=True)):
            mean, deviation = found[f"m{i}"] or 0.0, found[f"s{i}"] or 1.0
            scaled.append(f"(CAST(`{column}` AS DOUBLE) - ({mean!r}D)) / {deviation!r}D AS `{out}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


MOMENTS = (("m", F.avg), ("s", F.stddev_pop))


class FirstLevelDropper(Estimator, HasInputCol, HasOutputCol):
    """Cut the first level off a one-hot vector."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        size = dataset.schema[self.getInputCol()].metadata["ml_attr"]["num_attrs"]
        return VectorSlicer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=list(range(1, size)))


def preparation(spec: ModelSpec, output: str = "encoded") -> list:
    """Scaled numbers and one-hot categories side by side.

    Levels go in alphabetical order; a category unseen at fit time becomes all zeros.
    """
    stages: list = []
    inputs: list[str] = []
    if spec.numeric:
        scaled = [f"{c}__scaled" for c in spec.numeric]
        stages.append(PopulationScaler(inputCols=list(spec.numeric), outputCols=scaled))
        inputs += scaled
    if spec.categorical:
        coded = [f"{c}__code" for c in spec.categorical]
        levels = [f"{c}__levels" for c in spec.categorical]
        stages.append(
            StringIndexer(
                inputCols=list(spec.categorical), outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=coded, outputCols=levels, dropLast=True))
        if spec.drop_first:
            for column in levels:
                stages.append(FirstLevelDropper(inputCol=column, outputCol=f"{column}_rest"))
            levels = [f"{c}_rest" for c in levels]
        inputs += levels
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error"))
    return stages


def best_features(k: int, source: str = "encoded", output: str = "features", label: str = "label"):
    """The ``k`` features with the largest ANOVA F."""
    selector = UnivariateFeatureSelector(
        featuresCol=source, outputCol=output, labelCol=label, selectionMode="numTopFeatures"
    )
    return selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)


def encode(df: DataFrame, spec: ModelSpec, output: str = "encoded") -> tuple[PipelineModel, DataFrame]:
    model = Pipeline(stages=preparation(spec, output)).fit(df)
    return model, model.transform(df)


def encoded_names(model: PipelineModel, spec: ModelSpec) -> list[str]:
    """Names of the encoded features, categories as ``column_level``."""
    names = list(spec.numeric)
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            for column, levels in zip(spec.categorical, stage.labelsArray, strict=True):
                names += [f"{column}_{level}" for level in levels[1 if spec.drop_first else 0 :]]
    return names


def feature_names(model: PipelineModel, spec: ModelSpec) -> list[str]:
    """Names of the features the classifier sees, after any selection."""
    names = encoded_names(model, spec)
    for stage in model.stages:
        if isinstance(stage, UnivariateFeatureSelectorModel):
            names = [names[i] for i in sorted(stage.selectedFeatures)]
    return names


def anova_f(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, f_value) of a one-way ANOVA per numeric column, in one pass.

    Columns turn into (feature, value) pairs that shrink map-side to one row per feature
    and label, whose deviations are taken around the label's own mean.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    cells = (
        df.select(F.col(label).alias("label"), F.explode(pairs).alias("pair"))
        .where(F.col("pair.value").isNotNull())
        .groupBy("pair.feature", "label")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg("pair.value").alias("mean"),
            F.var_pop("pair.value").alias("spread"),
        )
    )
    totals = cells.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).cast("double").alias("groups"),
        F.sum(F.col("n") * F.col("mean")).alias("total"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
        F.sum(F.col("n") * F.col("spread")).alias("within"),
    )
    between = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("groups") - 1)
    within = F.col("within") / (F.col("n") - F.col("groups"))
    return totals.select("feature", (between / F.nullif(within, F.lit(0.0))).alias("f_value"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations as (left_feature, right_feature, correlation), all pairs."""
    whole = df.na.drop("any", subset=list(columns))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(whole).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "left_feature string, right_feature string, correlation double")


def collinear_pairs(df: DataFrame, columns: Sequence[str], above: float = 0.8) -> DataFrame:
    """Feature pairs whose correlation exceeds ``above`` in size, each pair once."""
    order = {c: i for i, c in enumerate(columns)}
    position = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    found = correlations(df, columns)
    return found.where(
        (position[F.col("left_feature")] < position[F.col("right_feature")]) & (F.abs("correlation") > above)
    )


def class_weight(label: str, weights: tuple[float, float]):
    return F.when(F.col(label) == 1, float(weights[1])).otherwise(float(weights[0]))
