"""Shared folds, statistics and fits against single ones."""

import numpy as np
import pytest
from conftest import rows

from vitalspan.ml import cv, models, shared
from vitalspan.ml.specs import ModelSpec


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    made = []
    for i in range(240):
        x, y = draw.normal(5, 3), draw.normal(-2, 0.5)
        c = str(draw.choice(["a", "b", "c"]))
        label = float(draw.random() < 1 / (1 + np.exp(-(0.6 * (x - 5) - 1.2 * (y + 2) + (c == "a") - 0.8))))
        made.append((i, label, float(x), float(y), float(i % 7), c))
    return spark.createDataFrame(made, "row_id long, label double, x double, y double, z double, c string").cache()


def test_identified_rows_have_stable_unique_keys(spark):
    made = [(1, None, "a"), (1, None, "a"), (1, "a", None), (None, "1", "a"), (1, "a", None)]
    df = spark.createDataFrame(made, "k int, l string, m string")
    got = shared.identified(df).collect()
    again = shared.identified(df.repartition(3)).collect()
    assert len({r["row_id"] for r in got}) == 5 and {tuple(r) for r in got} == {tuple(r) for r in again}
    assert sorted(map(str, (tuple(r)[1:] for r in got))) == sorted(map(str, made))
    assert shared.identified(df.limit(0)).collect() == []


def test_left_out_statistics_are_those_of_the_training_rows(data):
    encoded = shared.encode_once(data, ["x", "y", "z"], ["c"], 4)
    rest = shared.left_out(shared.cells(encoded), 4)
    frame = encoded.frame.toPandas()
    x = np.stack(frame["features"])
    for r in shared.fold_anova(rest).collect():
        keep = (frame["fold"] != r["without"]).to_numpy()
        groups = [x[keep & (frame["label"] == v).to_numpy(), r["feature"]] for v in (0, 1)]
        whole = np.concatenate(groups)
        between = sum(len(g) * (g.mean() - whole.mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert r["f_value"] == pytest.approx(between / (within / (len(whole) - 2)), rel=1e-9)
    for r in shared.fold_scalers(rest).collect():
        part = x[(frame["fold"] != r["without"]).to_numpy(), r["feature"]]
        assert (r["mean"], r["deviation"]) == (pytest.approx(part.mean(), abs=1e-12), pytest.approx(part.std(), rel=1e-9))


def test_shared_fits_equal_single_fits(spark, data):
    full = ModelSpec(("x", "y", "z"), ("c",), kind="lbfgs", folds=3)
    small = ModelSpec(("x",), kind="lbfgs", folds=3, weights=None)
    best = ModelSpec(("x", "y", "z"), ("c",), kind="lbfgs", folds=3, select=2)
    candidates = [(full, 1.0), (full, 60.0), (small, 1.0), (best, 10.0)]
    fits = shared.cross_fit(data, candidates)
    folded = cv.stratified_folds(data, "row_id", k=3)
    for number, (spec, cost) in enumerate(candidates):
        for fold in range(3):
            column = fits.columns[3 * number + fold]
            single = models.fit_model(folded.where(f"fold != {fold}"), spec, cost)
            want = dict(map(tuple, models.coefficients(single, spec, spark).collect()))
            got = {fits.encoded.shown(k): column.coefficients[k] for k in np.flatnonzero(column.mask)}
            assert set(got) == set(want)
            assert got == pytest.approx(want, abs=2e-3)
    assert fits.passes == max(c.passes for c in fits.columns)
    alone = shared.cross_fit(data, [(full, 60.0)])
    # More candidates do not make more passes than the slowest needs.
    assert fits.passes <= max(alone.passes, max(c.passes for c in fits.columns))
    for got, want in zip(alone.columns, fits.columns[3:6]):
        assert np.allclose(got.coefficients[got.mask], want.coefficients[want.mask], atol=1e-6)
    assert fits.scored.count() == 4 * data.count()


def test_shared_fits_equal_a_newton_solve(data):
    spec = ModelSpec(("x", "y"), kind="lbfgs", folds=2, weights=(30.0, 70.0))
    fits = shared.cross_fit(data, [(spec, 10.0)])
    frame = fits.encoded.frame.toPandas()
    for column in fits.columns:
        keep = (frame["fold"] != column.without).to_numpy()
        x = (np.stack(frame["features"])[keep] - column.mean) / column.deviation
        x, y = np.column_stack([x, np.ones(len(x))]), frame["label"].to_numpy()[keep]
        weight, w = np.where(y == 1, 70.0, 30.0) * 10.0, np.zeros(3)
        ridge = np.diag([1.0, 1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        assert np.allclose(np.append(column.coefficients, column.intercept), w, atol=1e-6)


def test_sweep_has_a_line_per_model_cost_and_filter(spark, data):
    dated = data.selectExpr("*", "date_add(date'2019-11-01', cast(row_id as int)) AS start_date")
    chosen = {"one": ModelSpec(("x",), costs=(1.0, 10.0), kind="lbfgs", folds=3), "two": ModelSpec(("x", "y"), ("c",), costs=(1.0,), kind="lbfgs", folds=3)}
    got = shared.sweep_logistic(dated, chosen)
    want = cv.sweep(dated, chosen)
    assert got.schema == want.schema
    for a, b in zip(rows(got, "model_name", "outside_spell", "c", "accuracy", "f1", "roc_auc"), rows(want, "model_name", "outside_spell", "c", "accuracy", "f1", "roc_auc")):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-6)


def test_sigmoids_of_all_groups_equal_single_fits(spark):
    draw = np.random.default_rng(1)
    made = [(g, float(s), float(draw.random() < 1 / (1 + np.exp(-(0.5 + g) * s + g)))) for g in range(3) for s in draw.normal(size=200)]
    df = spark.createDataFrame(made, "fold int, score double, label double")
    from vitalspan.ml.calibrate import fit_sigmoid

    for r in shared.fit_sigmoids(df, ["fold"]).collect():
        slope, intercept = fit_sigmoid(df.where(f"fold = {r['fold']}"))
        assert (r["slope"], r["intercept"]) == (pytest.approx(slope, abs=1e-4), pytest.approx(intercept, abs=1e-4))
    apart = spark.createDataFrame([(0, -1.0, 0.0), (0, 1.0, 1.0)], "fold int, score double, label double")
    assert shared.fit_sigmoids(apart, ["fold"]).first()["slope"] > 0


def test_rows_with_text_keys_are_undersampled_alike(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from vitalspan.ml.sampling import edited_nearest_neighbours

    draw = np.random.default_rng(7)
    made = [(i, float(i % 4 == 0), [float(v) for v in draw.normal(i % 4 == 0, 1, 2)]) for i in range(80)]
    df = spark.createDataFrame(made, "row_id long, label double, v array<double>").withColumn("features", array_to_vector("v"))
    named = df.withColumn("row_id", F.concat(F.lit("k-"), F.col("row_id").cast("string")))
    sample = edited_nearest_neighbours()
    got = {int(r["row_id"][2:]) for r in sample(named, "features").collect()}
    assert got == {r["row_id"] for r in sample(df, "features").collect()} and len(got) < 80


def test_fits_near_separation_take_few_passes(spark):
    draw = np.random.default_rng(5)
    made = []
    for i in range(120):
        x = draw.normal(size=12) * 10.0 ** (np.arange(12) % 3)
        made.append((i, float(x[0] + x[3] + x[6] + 0.05 * draw.normal() > 0.5), *map(float, x)))
    names = [f"x{k}" for k in range(12)]
    df = spark.createDataFrame(made, "row_id long, label double, " + ", ".join(f"{n} double" for n in names))
    spec = ModelSpec(tuple(names), kind="lbfgs", folds=3)
    fits = shared.cross_fit(df, [(spec, cost) for cost in (1.0, 100.0)])
    assert fits.passes <= 25
    frame = fits.encoded.frame.toPandas()
    for column in fits.columns:
        keep = (frame["fold"] != column.without).to_numpy()
        x, y = np.stack(frame["features"])[keep], frame["label"].to_numpy()[keep]
        x = np.column_stack([(x - column.mean) / column.deviation, np.ones(len(x))])
        w = np.append(column.coefficients, column.intercept)
        weight = np.where(y == 1, 70.0, 30.0) * column.cost
        slope = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + np.append(column.coefficients, 0.0)
        assert np.abs(slope).max() <= 1e-7 * weight.sum()


def test_columns_with_much_curvature_take_turns(data, monkeypatch):
    spec = ModelSpec(("x", "y"), kind="lbfgs", folds=2)
    together = shared.cross_fit(data, [(spec, 1.0), (spec, 10.0)])
    monkeypatch.setattr(shared, "CURVATURES", 9)
    apart = shared.cross_fit(data, [(spec, 1.0), (spec, 10.0)])
    assert apart.passes == sum(c.passes for c in apart.columns) > together.passes
    for a, b in zip(apart.columns, together.columns):
        assert np.allclose([*a.coefficients, a.intercept], [*b.coefficients, b.intercept], atol=1e-9)
