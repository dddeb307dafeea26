"""Margin classifiers fitted together against fits by themselves."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from vitalspan.ml import cv, margins
from vitalspan.ml.specs import ModelSpec


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(5)
    made = []
    for i in range(240):
        x, y = draw.normal(5, 3), draw.normal(-2, 0.5)
        c = "rare" if i == 7 else str(draw.choice(["a", "b", "c"]))
        label = float(draw.random() < 1 / (1 + np.exp(-(0.6 * (x - 5) - 1.2 * (y + 2) + (c == "a") - 0.8))))
        made.append((f"k{i}", label, float(x), float(y), float(i % 7), 1.0, c))
    return spark.createDataFrame(made, "row_id string, label double, x double, y double, z double, one double, c string")


@pytest.mark.parametrize("most", [1, 15])
def test_steps_are_those_of_a_single_fit(spark, most):
    draw = np.random.default_rng(1)
    x = np.sqrt(0.25) * np.cos(draw.normal(size=(300, 8)) * 2 + 1)
    y = (x[:, 0] + draw.normal(size=300) * 0.3 > 0).astype(float)
    w, sign = np.where(y == 1, 70.0, 30.0), np.where(y == 1, 1.0, -1.0)
    total, ridge = w.sum(), 1 / (0.2 * w.sum())
    mean = w @ x / total
    spread = np.sqrt((w @ (x * x) - total * mean * mean) / (total - (w * w).sum() / total))
    run = margins.quasi_newton(9, most)
    point = next(run)
    try:
        while True:
            slopes, constant = point[:-1] / spread, point[-1] - point[:-1] / spread @ mean
            short = 1 - sign * (x @ slopes + constant)
            pull = -sign * w * (short > 0)
            value = (w * np.maximum(short, 0)).sum() / total + 0.5 * ridge * slopes @ slopes
            slope = np.append(((x - mean) / spread).T @ pull / total + ridge * slopes / spread, pull.sum() / total)
            point = run.send((value, slope))
    except StopIteration as done:
        point = done.value
    df = spark.createDataFrame([(float(a), float(b), Vectors.dense(v)) for a, b, v in zip(y, w, x)], ["label", "w", "features"])
    model = LinearSVC(weightCol="w", regParam=ridge, standardization=False, maxIter=most).fit(df)
    np.testing.assert_allclose(point[:-1] / spread, model.coefficients.toArray(), atol=1e-9)


def test_margins_fitted_together_equal_single_fits(data):
    chosen = {
        "plain": ModelSpec(("x", "one"), folds=2),
        "full": ModelSpec(("z", "x", "y", "one"), ("c",), (35.0, 65.0), (0.25, 1.0), folds=2),
        "best": ModelSpec(("x", "y", "z"), ("c",), select=3, folds=2),
        "rest": ModelSpec(("x", "y"), ("c",), drop_first=True, folds=2),
    }
    got, want = (f(data, chosen, date=None, components=16, maxIter=6).collect() for f in (margins.sweep_margins, cv.sweep))
    shown = lambda lines: {(r["model_name"], r["c"]): [r[m] for m in cv.METRICS] for r in lines}
    got, want = shown(got), shown(want)
    assert got.keys() == want.keys()
    for key, line in want.items():
        assert got[key] == pytest.approx(line, abs=1e-9), key


def test_more_candidates_take_no_more_passes(data):
    spec = ModelSpec(("x", "y"), ("c",), folds=2)
    costs = (0.1, 0.5)
    alone = [margins.cross_margins(data, [(spec, c)], components=16, maxIter=3).passes for c in costs]
    assert margins.cross_margins(data, [(spec, c) for c in costs], components=16, maxIter=3).passes == max(alone)


def test_grid_of_margins_equals_single_fits(data):
    spec = ModelSpec(("x", "y"), ("c",), folds=2)
    got, want = (f(data, spec, (0.2,), ((20.0, 80.0), (30.0, 70.0)), components=16, maxIter=4).collect() for f in (margins.grid_margins, cv.grid_search))
    assert [(r["c"], r["weight_0"], pytest.approx(r["f1"], abs=1e-9)) for r in got] == [(r["c"], r["weight_0"], r["f1"]) for r in want]


def test_missing_numbers_are_an_error(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i == 3 else float(i)) for i in range(12)], "row_id long, label double, x double")
    with pytest.raises(ValueError, match="NULL or NaN"):
        margins.cross_margins(df, [(ModelSpec(("x",), folds=2), 1.0)], components=4, maxIter=2)
