"""Cost-weighted classifiers in the C form: cost times weighted loss plus half the squared norm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.ml.prep import best_features, class_weight, encoded_names, feature_names, preparation
from vitalspan.ml.specs import ModelSpec


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An approximation of the Gaussian kernel by random cosines.

    The inner product of two outputs tends to ``exp(-gamma |x - y|^2)`` as ``components``
    grows. Directions come from the seed, so a saved stage carries no matrix and a task
    rebuilds the same one; it has inputs x components entries whatever the data size.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "output dimensions", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=1.0, components=256, seed=1):
        super().__init__()
        self._setDefault(gamma=1.0, components=256, seed=1)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma = self.getOrDefault(self.gamma)
        size = self.getOrDefault(self.components)
        seed = self.getOrDefault(self.seed)

        @F.pandas_udf("array<double>")
        def project(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            rows = np.stack(batch.to_numpy())
            source = np.random.default_rng(seed)
            directions = source.normal(scale=np.sqrt(2 * gamma), size=(rows.shape[1], size))
            offsets = source.uniform(0, 2 * np.pi, size=size)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(rows @ directions + offsets)))

        source = vector_to_array(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(source)))


def kernel_width(df: DataFrame, features: str) -> float:
    """1 / (dimensions x variance over all matrix entries), from one aggregate."""
    found = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
    mean, count = found["mean"].toArray(), found["count"]
    spread = found["variance"].toArray() * (count - 1) / count
    overall = float(np.mean(spread + mean**2) - np.mean(mean) ** 2)
    return 1.0 / (len(mean) * overall) if overall > 0 else 1.0


def without_summary(model):
    """A fitted classifier that has let go of its training summary.

    The summary refers to the session, which can no longer be sent to tasks once anything has
    been observed in it (``DataFrame.observe``), and every task of a transform gets the model.
    """
    model._call_java("setSummary", model._java_obj.trainingSummary().empty())
    return model


class _CostEstimator(Estimator, HasFeaturesCol, HasLabelCol):
    cost = Param(Params._dummy(), "cost", "weight of the loss", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "weights of label 0 and 1", TypeConverters.toListFloat)

    def _weighted(self, dataset: DataFrame) -> tuple[DataFrame, float]:
        pair = self.getOrDefault(self.weights)
        marked = dataset.withColumn("class_weight", class_weight(self.getLabelCol(), (pair[0], pair[1])))
        total = marked.agg(F.sum("class_weight")).first()[0]
        return marked, 1.0 / (self.getOrDefault(self.cost) * total)


class CostLogistic(_CostEstimator):
    """L2 logistic regression; the intercept is free."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", cost=1.0, weights=(1.0, 1.0)):
        super().__init__()
        self._setDefault(cost=1.0, weights=[1.0, 1.0])
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        marked, strength = self._weighted(dataset)
        model = LogisticRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            weightCol="class_weight",
            regParam=strength,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=1000,
            tol=1e-7,
        ).fit(marked)
        return without_summary(model)


class CostMargin(_CostEstimator):
    """Maximum-margin classifier with an approximate Gaussian kernel of data-scaled width."""

    components = Param(Params._dummy(), "components", "kernel dimensions", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, featuresCol="features", labelCol="label", cost=1.0, weights=(1.0, 1.0), components=256, seed=1, maxIter=50
    ):
        super().__init__()
        self._setDefault(cost=1.0, weights=[1.0, 1.0], components=256, seed=1, maxIter=50)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        marked, strength = self._weighted(dataset)
        spread = RandomFourierFeatures(
            inputCol=self.getFeaturesCol(),
            outputCol="kernel_features",
            gamma=kernel_width(marked, self.getFeaturesCol()),
            components=self.getOrDefault(self.components),
            seed=self.getOrDefault(self.seed),
        )
        margin = LinearSVC(
            featuresCol="kernel_features",
            labelCol=self.getLabelCol(),
            weightCol="class_weight",
            regParam=strength,
            standardization=False,
            maxIter=self.getOrDefault(self.maxIter),
        ).fit(spread.transform(marked))
        return PipelineModel(stages=[spread, without_summary(margin)])


def classifier(spec: ModelSpec, cost: float, **options):
    weights = list(spec.weights or (1.0, 1.0))
    kind = CostLogistic if spec.kind == "lbfgs" else CostMargin
    return kind(featuresCol="features", labelCol="label", cost=cost, weights=weights, **options)


def fit_model(train: DataFrame, spec: ModelSpec, cost: float, sampler=None, **options) -> PipelineModel:
    """Preparation, then sampling of the training rows only, then selection and classifier."""
    output = "encoded" if spec.select else "features"
    prepared = Pipeline(stages=preparation(spec, output)).fit(train)
    encoded = prepared.transform(train)
    if sampler is not None:
        encoded = sampler(encoded, output)
    rest = ([best_features(spec.select)] if spec.select else []) + [classifier(spec, cost, **options)]
    fitted = Pipeline(stages=rest).fit(encoded)
    stages = []
    for stage in (*prepared.stages, *fitted.stages):
        stages += stage.stages if isinstance(stage, PipelineModel) else [stage]
    return PipelineModel(stages=stages)


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``score`` (decision value), ``probability_1`` where the model has one, and ``prediction``."""
    scored = model.transform(rows).withColumn("score", vector_to_array("rawPrediction")[1])
    if "probability" in scored.columns:
        scored = scored.withColumn("probability_1", vector_to_array("probability")[1])
    return scored


def coefficients(model: PipelineModel, spec: ModelSpec, spark) -> DataFrame:
    """(feature, coefficient) of a linear model, named after encoding and selection."""
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        values = last.coefficients.toArray()
        names = feature_names(model, spec)
    elif isinstance(last, LinearSVCModel):
        raise ValueError("kernel coefficients do not belong to single features")
    else:
        raise TypeError(type(last).__name__)
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


__all__ = [
    "CostLogistic",
    "CostMargin",
    "RandomFourierFeatures",
    "classifier",
    "coefficients",
    "encoded_names",
    "fit_model",
    "kernel_width",
    "scores",
]
