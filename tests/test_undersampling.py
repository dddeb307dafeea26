"""Neighbours and under-sampling of all folds at once against each fold by itself."""

import numpy as np
import pytest

from vitalspan.ml import cv, margins, neighbours, sampling, shared
from vitalspan.ml.specs import ModelSpec


@pytest.mark.parametrize("block_rows, skip", [(1000, None), (10, None), (10, 1.0)])
def test_nearest_rows_outside_each_fold_equal_brute_force(spark, block_rows, skip):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 5, (120, 3)).astype(float)
    x[:30] = x[0]  # equal vectors in many folds
    x[30:50, 0] += 0.5
    points = [(i, float(draw.random() < 0.4), int(i % 7 % 4), v.tolist()) for i, v in enumerate(x)]
    ratios = np.array([[1.0, 0.6, 0.9], [0.7, 1.0, 1.0], [0.95, 0.8, 0.55]])
    df = spark.createDataFrame(points, "row_id long, label double, fold int, vector array<double>")
    got = {}
    for r in neighbours.nearest_outside(df, [0, 1, 3], ratios, 3, block_rows, skip, fan=3).collect():
        assert (r["row_id"], r["without"]) not in got
        got[r["row_id"], r["without"]] = [(round(n["gap"], 9), n["row_id"], n["label"]) for n in r["near"]]
    want = {}
    for i, label, fold, v in points:
        for without, ratio in zip((0, 1, 3), ratios):
            if fold != without and label != skip:
                others = [(round(float(np.sqrt(((np.array(w) - v) ** 2 * ratio).sum())), 9), j, y) for j, y, g, w in points if j != i and g != without]
                want[i, without] = sorted(others)[:3]
    assert got == want


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(6)
    made = []
    for i in range(200):
        x, y = draw.normal(5, 3), draw.normal(-2, 0.5)
        # The level dropped first stands in one row, so one fold drops another.
        c = "a" if i == 11 else "rare" if i == 7 else str(draw.choice(["b", "c", "d"]))
        label = float(draw.random() < 1 / (1 + np.exp(-(0.6 * (x - 5) - 1.2 * (y + 2) - 0.8))))
        made.append((f"k{i}", label, float(x), float(y), 90.0 if i == 3 else float(i % 7), 1.0, c))
    made += [(f"twice{i}", *made[i][1:]) for i in range(0, 60, 2)]
    return spark.createDataFrame(made, "row_id string, label double, x double, y double, z double, one double, c string")


MODELS = {
    "full": ModelSpec(("z", "x", "y", "one"), ("c",), drop_first=True, folds=3, undersample=True),
    "few": ModelSpec(("x", "y"), ("c",), (35.0, 65.0), (0.25,), folds=3, undersample=True),
}


def test_undersampled_margins_equal_single_fits(data):
    sampler = sampling.edited_nearest_neighbours()
    got, want = (f(data, MODELS, date=None, sampler=sampler, components=16, maxIter=6).collect() for f in (margins.sweep_margins, cv.sweep))
    shown = lambda lines: {(r["model_name"], r["c"]): [r[m] for m in cv.METRICS] for r in lines}
    got, want = shown(got), shown(want)
    assert got.keys() == want.keys()
    for key, line in want.items():
        assert got[key] == pytest.approx(line, abs=1e-9), key


def test_folds_share_searches_where_their_metrics_are_alike(data):
    encoded = shared.encode_once(data, ("x", "y", "z", "one"), ("c",), 3)
    full, few = (margins.views(encoded, [s]) for s in MODELS.values())
    assert [places for places, _, _ in sampling.searches(few, len(encoded.names))] == [[0, 1, 2]]
    apart = sampling.searches(full, len(encoded.names))
    assert sorted(p for places, _, _ in apart for p in places) == [0, 1, 2] and len(apart) > 1
    for places, scales, ratios in apart:
        assert (ratios > 0).all() and (ratios <= 1).all()
        for place, ratio in zip(places, ratios):
            kernel = full[place]
            assert np.allclose((scales**2 * ratio)[kernel.used], 1 / kernel.deviation**2)


def test_cosines_are_those_of_doubles():
    angles = np.random.default_rng(2).normal(size=(300, 500)) * 20
    assert np.allclose(margins.cosines(angles.copy(), 0.25), 0.25 * np.cos(angles), rtol=0, atol=1e-13)


def test_steps_without_a_limit_run_until_they_have_converged():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 6))
    sign = np.where(x[:, 0] + draw.normal(size=200) > 0, 1.0, -1.0)

    def fitted(most):
        run = margins.quasi_newton(6, most)
        point, count = next(run), 0
        try:
            while True:
                short = 1 - sign * (x @ point)
                count += 1
                point = run.send((np.maximum(short, 0).mean() + 0.05 * point @ point, -(sign * (short > 0)) @ x / 200 + 0.1 * point))
        except StopIteration as done:
            return done.value, count

    (few, early), (many, late), (free, last) = (fitted(n) for n in (5, 100_000, None))
    assert early < last == late and np.array_equal(free, many) and not np.array_equal(free, few)


def test_undersampled_models_are_fitted_in_full(monkeypatch):
    from catalog import model_queries

    asked = {}
    monkeypatch.setattr(model_queries, "model_rows", lambda spark, sf_dir: None)
    monkeypatch.setattr(model_queries.margins, "sweep_margins", lambda rows, models, **options: asked.update(options, models=models))
    model_queries.undersampled_models(None, "")
    assert asked["maxIter"] is None and asked.get("components", 256) >= 256
    assert asked["models"] is model_queries.UNDERSAMPLED_MODELS and asked["sampler"].k == 3
