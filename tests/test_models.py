import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vitalspan.ml import calibrate, cv, evaluate, models, neighbours, prep, sampling
from vitalspan.ml.specs import CATEGORICAL, FULL_NUMERIC, LOGIT_MODELS, MARGIN_MODELS, REDUCED_NUMERIC, ModelSpec
from vitalspan.session import scratch_path
from vitalspan.sources import tables

SPEC = ModelSpec(("x", "y"), ("c",), kind="lbfgs", folds=3)


@pytest.fixture(scope="module")
def sample(spark):
    source = np.random.default_rng(7)
    x, y = source.normal(size=150), source.normal(3, 2, size=150)
    c = source.choice(["p", "q", "r"], size=150)
    label = (x + 0.4 * (c == "q") + source.normal(size=150) > 0.9).astype(float)
    data = [(i, float(a), float(b), str(k), float(v)) for i, (a, b, k, v) in enumerate(zip(x, y, c, label, strict=True))]
    return spark.createDataFrame(data, "row_id long, x double, y double, c string, label double").coalesce(2).cache()


def test_feature_sets():
    assert len(FULL_NUMERIC) == 40 and len(REDUCED_NUMERIC) == 32
    assert MARGIN_MODELS["full"].columns == FULL_NUMERIC + CATEGORICAL
    assert sum(len(s.costs) for s in LOGIT_MODELS.values()) * 2 * 10 == 400
    assert sum(len(s.costs) for s in MARGIN_MODELS.values()) * 2 * 5 == 110


def test_scaling_uses_the_population_deviation_and_zeroes_constants(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5)], "a double, b int")
    model = prep.PopulationScaler(inputCols=["a", "b"], outputCols=["s", "t"]).fit(df)
    found = np.array([tuple(r) for r in model.transform(df).select("s", "t").collect()])
    values = np.array([1.0, 2.0, 4.0])
    assert np.allclose(found[:, 0], (values - values.mean()) / values.std())
    assert np.allclose(found[:, 1], 0)
    assert model.transform(spark.createDataFrame([(1.0, 9)], "a double, b int")).first()["t"] == 4.0


def test_unseen_categories_are_all_zeros(spark, sample):
    unseen = spark.createDataFrame([(1, 0.0, 3.0, "zzz", 0.0)], sample.schema)
    for drop, names in ((False, ["x", "y", "c_p", "c_q", "c_r"]), (True, ["x", "y", "c_q", "c_r"])):
        spec = ModelSpec(("x", "y"), ("c",), drop_first=drop)
        model, encoded = prep.encode(sample, spec)
        assert prep.encoded_names(model, spec) == names
        assert encoded.first()["encoded"].size == len(names)
        assert model.transform(unseen).first()["encoded"].toArray()[2:].sum() == 0


def newton(matrix, labels, weights, cost):
    """Minimise half the squared norm plus cost times weighted log loss, free intercept."""
    design = np.hstack([matrix, np.ones((len(matrix), 1))])
    ridge = np.eye(design.shape[1])
    ridge[-1, -1] = 0
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = ridge @ beta + cost * design.T @ (weights * (p - labels))
        curve = ridge + cost * (design.T * (weights * p * (1 - p))) @ design
        beta -= np.linalg.solve(curve, slope)
    return beta


@pytest.mark.parametrize("cost", [0.01, 1.0])
def test_logistic_coefficients_equal_a_newton_solve(spark, sample, cost):
    model = models.fit_model(sample, SPEC, cost)
    encoded = model.stages
    features = sample
    for stage in encoded[:-1]:
        features = stage.transform(features)
    data = features.select("features", "label").collect()
    matrix = np.array([r["features"].toArray() for r in data])
    labels = np.array([r["label"] for r in data])
    want = newton(matrix, labels, np.where(labels == 1, 70.0, 30.0), cost)
    found = {r["feature"]: r["coefficient"] for r in models.coefficients(model, SPEC, spark).collect()}
    assert list(found) == ["x", "y", "c_p", "c_q", "c_r"]
    assert np.allclose(list(found.values()), want[:-1], atol=2e-3)
    assert math.isclose(model.stages[-1].intercept, want[-1], abs_tol=2e-3)


def test_anova_agrees_with_the_selector(spark, sample):
    both = sample.withColumn("z", F.col("x") * 0.5 + F.col("y"))
    found = {r["feature"]: r["f_value"] for r in prep.anova_f(both, ["x", "y", "z"]).collect()}
    spec = ModelSpec(("x", "y", "z"), kind="lbfgs", select=2, folds=3)
    model = models.fit_model(both, spec, 1.0)
    assert set(prep.feature_names(model, spec)) == set(sorted(found, key=found.get)[-2:])
    data = np.array([(r["label"], r["x"]) for r in both.collect()])
    groups = [data[data[:, 0] == v, 1] for v in (0, 1)]
    mean = data[:, 1].mean()
    between = sum(len(g) * (g.mean() - mean) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(data) - 2)
    assert math.isclose(found["x"], between / within, rel_tol=1e-9)


def test_collinear_pairs_are_listed_once(spark, sample):
    wide = sample.withColumn("z", -2 * F.col("x"))
    assert rows(prep.collinear_pairs(wide, ["x", "y", "z"], 0.9), "left_feature", "right_feature") == [("x", "z")]


def test_random_features_approach_the_kernel(spark):
    source = np.random.default_rng(3)
    points = source.normal(size=(40, 3))
    df = spark.createDataFrame([(Vectors.dense(p),) for p in points], ["v"])
    gap = ((points[:, None] - points[None]) ** 2).sum(-1)
    errors = []
    for components in (16, 2048):
        stage = models.RandomFourierFeatures(inputCol="v", outputCol="z", gamma=0.3, components=components, seed=5)
        z = np.array([r["z"].toArray() for r in stage.transform(df).collect()])
        errors.append(np.abs(z @ z.T - np.exp(-0.3 * gap)).mean())
    assert errors[1] < errors[0] / 3 and errors[1] < 0.03
    width = models.kernel_width(df, "v")
    assert math.isclose(width, 1 / (3 * points.var()), rel_tol=1e-9)


def test_margin_classifier_learns_a_ring(spark):
    source = np.random.default_rng(4)
    points = source.normal(size=(200, 2))
    data = [(i, float(a), float(b), float(a * a + b * b < 1)) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(data, "row_id long, a double, b double, label double")
    spec = ModelSpec(("a", "b"), weights=None, folds=3)
    result = cv.cross_validate(df, spec, 1.0, components=200)
    mean = result.mean().first()
    assert mean["accuracy"] > 0.85 and mean["roc_auc"] > 0.9


def test_folds_differ_by_one_per_label(sample):
    folded = cv.stratified_folds(sample, "row_id", k=4)
    assert folded.count() == sample.count()
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in folded.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert rows(folded, "row_id", "fold") == rows(cv.stratified_folds(sample.repartition(7), "row_id", k=4), "row_id", "fold")


def brute_force(points, k):
    kept = []
    sizes = {v: sum(p[1] == v for p in points) for v in (0.0, 1.0)}
    smallest = min(sizes, key=lambda v: (sizes[v], -v))
    for row, label, vector in points:
        near = sorted((math.dist(vector, v), r, n) for r, n, v in points if r != row)[:k]
        if label == smallest or all(n == label for _, _, n in near):
            kept.append((row,))
    return sorted(kept, key=str)


@pytest.mark.parametrize("kind", ["spread", "grid", "copies"])
def test_edited_rows_equal_brute_force(spark, kind):
    source = random.Random(9)
    points = []
    for i in range(220):
        if kind == "spread":
            centre = source.choice([0.0, 5.0, 40.0])
            vector = [centre + source.gauss(0, 1) for _ in range(3)]
        elif kind == "grid":
            vector = [float(source.randint(0, 4)), float(source.randint(0, 4))]
        else:
            vector = [1.0, 2.0] if i % 3 == 0 else [source.random(), source.random()]
        points.append((i, float(source.random() < 0.3), vector))
    df = spark.createDataFrame(points, "row_id long, label double, vector array<double>")
    for block_rows in (10_000, 25):
        assert rows(sampling.edited_rows(df, 3, block_rows), "row_id") == brute_force(points, 3)


def test_vectors_travel_only_to_cells_within_their_radius(spark):
    # Nine clumps a thousand apart: no radius reaches another clump.
    source = random.Random(4)
    points = [(i, float(i % 5 == 0), [1000.0 * (i % 9) + source.random(), source.random()]) for i in range(900)]
    df = spark.createDataFrame(points, "row_id long, label double, vector array<double>")
    distinct = neighbours.copies(df, 4)
    placed, levels = neighbours.grow(distinct, 900, 20, fan=8)
    assert len(levels) == 2 and placed.count() == 900
    assert levels[0].count() == 8 and levels[1].count() <= 64
    clump = lambda column: F.floor(F.col(column)[0] / 1000)
    asking = distinct.select("vector_id", "vector", F.lit(2.0).alias("reach"), F.lit(0).alias("own"))
    sent = neighbours.route(asking, levels, 20)
    # Each vector reaches its own cell, and only cells with a vector no farther than their radius allows.
    homes = sent.join(placed.select("vector_id", F.col("cell").alias("home")), "vector_id")
    assert homes.where("cell = home").count() == 900
    seen = placed.groupBy("cell").agg(F.collect_set(clump("vector")).alias("clumps"))
    far = sent.join(seen, "cell").where((F.size("clumps") == 1) & ~F.array_contains("clumps", clump("vector")))
    assert far.count() == 0
    assert sent.count() < 900 * levels[1].count() / 3
    # Without a radius every vector meets every cell.
    wide = neighbours.route(asking.withColumn("reach", F.lit(float("inf"))), levels, 20)
    assert wide.count() == 900 * levels[1].count()


@pytest.mark.parametrize("skip", [None, 0.0])
def test_nearest_rows_of_a_deep_tree_equal_brute_force(spark, skip):
    source = random.Random(6)
    points = [(i, float(i % 3 == 0), [round(source.gauss(50 * (i % 4), 9)) + 0.0, 1e6]) for i in range(260)]
    df = spark.createDataFrame(points, "row_id long, label double, vector array<double>")
    found = neighbours.nearest_rows(df, 3, 10, skip, fan=3).collect()
    asked = [p for p in points if p[1] != skip]
    expected = {r: sorted((math.dist(v, w), s) for s, _, w in points if s != r)[:3] for r, _, v in asked}
    assert {r.row_id: [(n.gap, n.row_id) for n in r.near] for r in found} == expected and len(found) == len(asked)


def test_no_rows_have_no_neighbours(spark):
    df = spark.createDataFrame([], "row_id long, label double, vector array<double>")
    assert neighbours.nearest_rows(df).count() == 0 and sampling.edited_rows(df).count() == 0


def test_sampling_touches_training_rows_only(spark, sample):
    result = cv.cross_validate(sample, SPEC, 1.0, sampler=sampling.edited_nearest_neighbours())
    assert result.folds.count() == 3
    assert result.folds.where("accuracy > 0 AND roc_auc BETWEEN 0 AND 1").count() == 3


def scored(spark, pairs):
    return spark.createDataFrame([(a, float(b)) for a, b in pairs], "label int, score double")


def test_area_counts_ties_half(spark):
    df = scored(spark, [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.2)])
    wins = [(p > n) + 0.5 * (p == n) for p in (0.9, 0.5, 0.2) for n in (0.9, 0.1, 0.5)]
    assert math.isclose(evaluate.roc_auc(df).first()[0], sum(wins) / 9)
    assert evaluate.roc_auc(scored(spark, [(1, 0.0), (0, 0.0)])).first()[0] == 0.5
    assert evaluate.roc_auc(scored(spark, [(1, 0.0)])).first()[0] is None


def test_roc_points_drop_straight_runs(spark):
    df = scored(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.4)])
    every = evaluate.roc_points(df, drop_intermediate=False, slots=3)
    kept = evaluate.roc_points(df, slots=3)
    assert rows(every, "threshold") == [(0.4,), (0.5,), (0.6,), (0.7,), (0.8,), (0.9,), (None,)]
    assert rows(kept, "threshold") == [(0.4,), (0.5,), (0.6,), (0.7,), (0.9,), (None,)]


def test_sweep_equals_testing_every_threshold(spark):
    pairs = [(i % 3 == 0, (i % 101) / 100) for i in range(300)] + [(True, 0.29), (False, 0.35), (True, 1.0), (False, 0.0)]
    df = scored(spark, [(int(a), b) for a, b in pairs])
    found = {round(r["threshold"] * 100): r for r in evaluate.threshold_sweep(df).collect()}
    assert len(found) == 100
    for i in range(100):
        said = [b >= i * 0.01 for _, b in pairs]
        tp = sum(a and s for (a, _), s in zip(pairs, said, strict=True))
        fp = sum((not a) and s for (a, _), s in zip(pairs, said, strict=True))
        assert (found[i]["tp"], found[i]["fp"]) == (tp, fp), i
    best = evaluate.best_threshold(evaluate.threshold_sweep(df)).first()
    assert best["f1"] == max(r["f1"] for r in found.values())


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    found = evaluate.class_metrics(df).first()
    assert (found["accuracy"], found["precision"], found["recall"], found["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_final_labels_exclude_the_threshold_itself(spark):
    found = evaluate.tuned_metrics(scored(spark, [(1, 0.3), (1, 0.4), (0, 0.1)]), 0.3).first()
    assert (found["tp"], found["fn"], found["roc_auc"]) == (1, 1, 0.75)


def test_reliability_bins_close_on_the_left(spark):
    df = scored(spark, [(1, 0.1), (0, 0.1999), (1, 1.0)])
    assert rows(evaluate.reliability_curve(df), "bin", "fraction_positive", "n") == [(1, 0.5, 2), (9, 1.0, 1)]
    wide = scored(spark, [(0, -2.0), (1, 3.0), (1, 0.5)])
    assert rows(evaluate.reliability_curve(wide, normalize=True), "bin", "mean_score") == [(0, 0.0), (5, 0.5), (9, 1.0)]


def test_sigmoid_fits_softened_targets(spark):
    source = np.random.default_rng(8)
    values = source.normal(size=300)
    labels = (source.random(300) < 1 / (1 + np.exp(-(2 * values - 0.5)))).astype(int)
    df = scored(spark, list(zip(labels.tolist(), values.tolist(), strict=True)))
    slope, intercept = calibrate.fit_sigmoid(df)
    high, low = (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2)
    design = np.column_stack([values, np.ones(300)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve((design.T * (p * (1 - p))) @ design, design.T @ (p - np.where(labels == 1, high, low)))
    assert np.allclose([slope, intercept], beta, atol=1e-3)


def test_calibrated_ensemble_survives_saving(spark, sample):
    ensemble = calibrate.calibrate(sample, ModelSpec(("x", "y"), ("c",)), 0.5, folds=2, components=32, maxIter=10)
    before = ensemble.transform(sample).select("row_id", F.round("probability_1", 9).alias("p"))
    path = scratch_path(spark, "ensemble")
    ensemble.save(spark, path)
    after = calibrate.CalibratedEnsemble.load(spark, path).transform(sample).select("row_id", F.round("probability_1", 9).alias("p"))
    assert rows(before, "row_id", "p") == rows(after, "row_id", "p")
    assert before.where("p <= 0 OR p >= 1").count() == 0


def test_grid_ranks_points_and_sweep_feeds_the_log(spark, sample):
    spec = ModelSpec(("x", "y"), ("c",), kind="lbfgs", folds=2)
    found = cv.grid_search(sample, spec, (0.1, 1.0), ((20.0, 80.0), (30.0, 70.0))).collect()
    assert len(found) == 4 and [r["f1"] for r in found] == sorted((r["f1"] for r in found), reverse=True)
    dated = sample.withColumn("start_date", F.expr("date_add(DATE'2019-10-01', CAST(row_id * 2 AS INT))"))
    lines = cv.sweep(dated, {"one": ModelSpec(("x",), costs=(1.0,), kind="lbfgs", folds=2)})
    path = scratch_path(spark, "log")
    tables.append_evaluations(lines, path)
    tables.append_evaluations(lines, path)
    log = tables.read_evaluations(spark, path, drop=["weights"])
    assert rows(log, "model_name", "outside_spell", "c") == [("one", False, 1.0)] * 2 + [("one", True, 1.0)] * 2
    assert "weights" not in log.columns and log.first()["features"] == ["x"]


def test_models_score_after_the_session_has_been_observed(spark, sample):
    """An observed session cannot be sent to tasks; a fitted model must not refer to it."""
    from pyspark.sql import Observation

    seen = Observation()
    sample.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 150
    for spec, options in ((SPEC, {}), (ModelSpec(("x", "y")), {"components": 8, "maxIter": 3})):
        model = models.fit_model(sample, spec, 1.0, **options)
        assert models.scores(model, sample).count() == models.scores(model, sample).where("score IS NOT NULL").count() == 150
        assert not model.stages[-1].hasSummary
        copied = model.copy()
        assert copied.transform(sample).where("prediction IS NOT NULL").count() == 150


def test_compared_rows_hold_a_bounded_number_of_distances(monkeypatch):
    draw = np.random.default_rng(3)
    rows_, others = draw.normal(size=(700, 5)), draw.normal(size=(900, 5))
    sizes, ids = np.ones(900, int), np.arange(900)
    whole = [np.concatenate(x) for x in zip(*neighbours._compared(rows_, others, sizes, ids, 4))]
    monkeypatch.setattr(neighbours, "PRODUCTS", 9_000)
    seen, squared = [], neighbours._squared
    monkeypatch.setattr(neighbours, "_squared", lambda a, b: seen.append(len(a) * len(b)) or squared(a, b))
    parts = [np.concatenate(x) for x in zip(*neighbours._compared(rows_, others, sizes, ids, 4))]
    assert max(seen) <= 9_000 and sum(seen) == 700 * 900
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    monkeypatch.setattr(neighbours, "PRODUCTS", 1)
    assert [s.stop - s.start for s in neighbours._steps(rows_[:3], others)] == [1, 1, 1]
