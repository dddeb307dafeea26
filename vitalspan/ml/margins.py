"""Maximum-margin classifiers whose folds and candidates share their passes over the data.

Rows are encoded and dealt to folds once (``shared.encode_once``). Each (features, fold) has
random cosines of its own, made from the encoded row wherever they are needed and never stored.
One pass sums loss and gradient of all (candidate, fold) columns; each column then takes the
quasi-Newton step that ``LinearSVC`` would take, so it ends where a fit by itself ends.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, replace
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.ml.cv import METRICS, SWEEP_COLUMNS
from vitalspan.ml.evaluate import class_metrics
from vitalspan.ml.sampling import EditedNearestNeighbours
from vitalspan.ml.shared import Encoded, _matrix, best_per_fold, cells, encode_once, fold_metrics, left_out
from vitalspan.ml.specs import ModelSpec
from vitalspan.plans.training import SPELL
from vitalspan.session import cut_lineage

#: Random cosines that a task holds at a time.
COSINES = 2_000_000


#: Series of the sine of a half turn, odd powers from the first.
HALF_TURN = [(-1) ** k * np.pi ** (2 * k + 1) / factorial(2 * k + 1) for k in range(11)]


def cosines(angles: np.ndarray, scale: float) -> np.ndarray:
    """``scale`` times the cosines of rows of angles, to double precision, in their place.

    A cosine is 1 - 2 times the squared sine of half the angle, whose series needs no branches;
    NumPy's own cosine of doubles takes twice as long. Few rows at a time stay in the cache.
    """
    step = max(1, 32_768 // max(1, angles.shape[1]))
    for at in range(0, len(angles), step):
        turn = angles[at : at + step]
        turn *= 0.5 / np.pi
        turn -= np.rint(turn)
        square = turn * turn
        out = np.full_like(square, HALF_TURN[-1])
        for c in HALF_TURN[-2::-1]:
            out *= square
            out += c
        turn *= out
        turn *= turn
        turn *= -2.0 * scale
        turn += scale
    return angles


@dataclass
class Kernel:
    """One fold's own view of a model's features, and its random cosines once they are drawn."""

    spec: ModelSpec
    without: int
    used: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    lacking: np.ndarray  # levels that its rows lack
    slopes: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def own(self, x: np.ndarray) -> np.ndarray:
        """The fold's own features of rows as they are stored."""
        return (x[:, self.used] - self.mean) / self.deviation

    def draw(self, gamma: float, components: int, seed: int) -> None:
        """Directions of ``RandomFourierFeatures``, turned to act on features as they are stored."""
        source = np.random.default_rng(seed)
        directions = source.normal(scale=np.sqrt(2 * gamma), size=(len(self.used), components))
        offsets = source.uniform(0, 2 * np.pi, size=components)
        self.slopes = directions / self.deviation[:, None]
        self.offsets = offsets - self.mean @ self.slopes

    def cosines(self, x: np.ndarray) -> np.ndarray:
        angles = x[:, self.used] @ self.slopes
        angles += self.offsets
        return cosines(angles, np.sqrt(2.0 / len(self.offsets)))


@dataclass
class Margin:
    """One fit: its candidate, its kernel's place, cost and weights of labels 0 and 1."""

    candidate: int
    kernel: int
    cost: float
    weights: tuple[float, float]
    coefficients: np.ndarray | None = None
    intercept: float = 0.0


def quasi_newton(size: int, most: int | None, tolerance: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimise a function whose values and gradients are sent in, by the steps of ``LinearSVC``.

    The direction is of limited memory, less what does not fall; a coordinate stops at 0 before
    its sign changes; a step shrinks or grows until it meets the Wolfe conditions. With ``most``
    None, steps go on until the last 20 have gained no more than the tolerance.
    """
    x = np.zeros(size)
    value, slope = yield x
    first, values = value, [np.inf]
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    count, failed = 0, False
    while most is None or count < most:
        if len(values) > 1 and abs(value - max(values)) <= tolerance * first or np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8):
            break
        found = None
        way = _direction(slope, moves)
        if way is not None:
            way = np.where(way * slope < 0, way, 0.0)
            side = np.where(x != 0, np.sign(x), np.sign(-slope))
            fall = float(way @ slope)
            length, shrink = (0.05 / np.linalg.norm(slope), 0.1) if count < 1 else (0.5, 0.5)
            for _ in range(21):
                if not 1e-10 <= length <= 1e10:
                    break
                new = x + length * way
                new = np.where(np.sign(new) == side, new, 0.0)
                at, pull = yield new
                rise = float(pull @ way)
                if at > value + 1e-4 * length * fall:
                    length *= shrink
                elif rise < 0.9 * fall:
                    length *= 2.1
                elif rise > -0.9 * fall:
                    length *= shrink
                else:
                    found = new, at, pull
                    break
        if found is None:
            if failed:
                break
            failed, moves = True, []
            continue
        new, at, pull = found
        moves = [(new - x, pull - slope), *moves][:memory]
        x, value, slope = new, at, pull
        values = [*values, value][-20:]
        count, failed = count + 1, False
    return x


def _direction(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """The limited-memory direction; none where the moves known allow none."""
    way, parts = slope.copy(), []
    for step, turn in moves:
        product = step @ turn
        part = (step @ way) / product if product else np.nan
        if not np.isfinite(part):
            return None
        way -= part * turn
        parts.append((part, product))
    if moves:
        step, turn = moves[0]
        if not step @ turn >= 0:
            return None
        way *= (step @ turn) / (turn @ turn)
    for (step, turn), (part, product) in zip(reversed(moves), reversed(parts)):
        way += (part - (turn @ way) / product) * step
    return -way


def _summed(frame: DataFrame, kernels: Sequence[Kernel], places: Sequence[int], room: int, add: Callable) -> np.ndarray:
    """The sum of ``add(x, label, inside)`` over rows in chunks of ``room``; one pass.

    ``inside`` has a column per kernel at ``places``: whether it is fitted on the row. Each task
    hands on one array, whatever its rows.
    """
    without, some = np.array([kernels[k].without for k in places]), np.array(places)
    sampled = "kept" in frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, room):
                part = batch.slice(at, room)
                inside = part.column("fold").to_numpy()[:, None] != without
                if sampled:
                    kept = part.column("kept").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    inside &= kept[:, some]
                found = add(_matrix(part), part.column("label").to_numpy() == 1, inside)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    rows = frame.select("label", "fold", "features", *(["kept"] if sampled else []))
    rows = rows.coalesce(frame.sparkSession.sparkContext.defaultParallelism)
    return np.sum([np.array(r["sums"]) for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)


def views(encoded: Encoded, specs: Sequence[ModelSpec]) -> list[Kernel]:
    """A kernel, not yet drawn, for every spec and fold.

    As in a preparation fitted on the fold's training rows, features are scaled by these alone,
    levels that they lack are no features, and a number constant there keeps its unit.
    """
    rest = cut_lineage(left_out(cells(encoded), encoded.folds))
    size, folds = len(encoded.names), encoded.folds
    n, s, q = (np.zeros((folds, size)) for _ in "nsq")
    for r in rest.collect():  # folds x labels x features
        for sums, c in ((n, "n"), (s, "s"), (q, "q")):
            sums[r["without"], r["feature"]] += r[c]
    if not (np.isfinite(s).all() and np.isfinite(q).all()):
        raise ValueError("features must not be NULL or NaN")
    level = np.arange(size) >= encoded.numeric
    mean = s / np.maximum(n, 1.0)
    spread = np.sqrt(np.maximum(q / np.maximum(n, 1.0) - mean * mean, 0.0))
    unit = np.ones(size)
    unit[: encoded.numeric] = 1.0 / np.array(encoded.units)
    deviation = np.where(level, 1.0, np.where(spread > 1e-9, spread, unit))
    mean = np.where(level, 0.0, mean)
    out = []
    for spec in specs:
        mask = encoded.mask(spec.columns)
        chosen = np.zeros((folds, size), bool)
        if spec.select:
            usable = [int(k) for k in np.flatnonzero(mask)]
            for r in best_per_fold(rest.where(F.col("feature").isin(usable)), spec.select).collect():  # folds x k
                chosen[r["without"], r["feature"]] = True
        for fold in range(folds):
            # Features in the spec's own order, which the random directions follow.
            there = [k for c in spec.columns for k in np.flatnonzero(encoded.mask([c])) if not level[k] or s[fold, k] > 0.5]
            if spec.drop_first:
                first = {next((k for k in there if level[k] and encoded.mask([c])[k]), None) for c in spec.categorical}
                there = [k for k in there if k not in first]
            if spec.select:
                there = [k for k in there if chosen[fold, k]]
            used = np.array(there, int)
            lacking = np.flatnonzero(level & (s[fold] <= 0.5))
            out.append(Kernel(spec, fold, used, mean[fold, used], deviation[fold, used], lacking))
    return out


def draw_kernels(frame: DataFrame, kernels: list[Kernel], components: int, seed: int) -> None:
    """Draw every kernel with the width of the rows it is fitted on; one pass."""
    size = max(len(k.used) for k in kernels)

    def add(x: np.ndarray, label: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.zeros((len(kernels), 1 + 2 * size))
        for place, kernel in enumerate(kernels):
            own = kernel.own(x[inside[:, place]])
            out[place, 0], out[place, 1 : 1 + own.shape[1]] = len(own), own.sum(0)
            out[place, 1 + size : 1 + size + own.shape[1]] = (own * own).sum(0)
        return out.ravel()

    sums = _summed(frame, kernels, range(len(kernels)), 4096, add).reshape(len(kernels), -1)
    for kernel, found in zip(kernels, sums):
        width, n = len(kernel.used), max(found[0], 1.0)
        mean, square = found[1 : 1 + width] / n, found[1 + size : 1 + size + width] / n
        overall = float(square.mean() - mean.mean() ** 2)
        kernel.draw(1.0 / (width * overall) if overall > 0 else 1.0, components, seed)


def fit_margins(frame: DataFrame, kernels: list[Kernel], columns: list[Margin], most: int | None) -> int:
    """Fit every column, all in the same passes; the number of passes.

    Each minimises the mean weighted hinge loss + half the squared norm / (cost x total weight),
    intercept free, over its kernel's rows.
    """
    size = len(kernels[0].offsets)
    room = max(1, COSINES // (size * len(kernels)))

    def moments(x: np.ndarray, label: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.zeros((len(kernels), 2, 1 + 2 * size))
        for place, kernel in enumerate(kernels):
            z = kernel.cosines(x)
            for side in (0, 1):
                mine = z[inside[:, place] & (label == side)]
                out[place, side] = np.concatenate([[len(mine)], mine.sum(0), (mine * mine).sum(0)])
        return out.ravel()

    sums = _summed(frame, kernels, range(len(kernels)), room, moments).reshape(len(kernels), 2, -1)
    runs = []
    for c in columns:
        pair = np.array(c.weights)
        n, s, q = sums[c.kernel][:, 0], sums[c.kernel][:, 1 : 1 + size], sums[c.kernel][:, 1 + size :]
        weight = float(pair @ n)
        mean = pair @ s / weight
        spread = np.sqrt(np.maximum(pair @ q - weight * mean * mean, 0.0) / (weight - float(pair * pair @ n) / weight))
        inverse = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)
        run = quasi_newton(size + 1, most)
        runs.append((c, run, next(run), weight, mean, inverse))
    passes = 0
    while runs:
        points = [(c, point[:-1] * inverse, point[-1] - float(point[:-1] * inverse @ mean)) for c, _, point, _, mean, inverse in runs]
        found = _losses(frame, kernels, points, room)
        passes += 1
        going = []
        for (c, run, point, weight, mean, inverse), sums in zip(runs, found):
            ridge = 1.0 / (c.cost * weight)
            value = sums[0] / weight + 0.5 * ridge * float((point[:-1] * inverse) @ (point[:-1] * inverse))
            slope = np.append((sums[1:-1] - mean * sums[-1]) * inverse / weight + ridge * point[:-1] * inverse**2, sums[-1] / weight)
            try:
                going.append((c, run, run.send((value, slope)), weight, mean, inverse))
            except StopIteration as done:
                c.coefficients = done.value[:-1] * inverse
                c.intercept = float(done.value[-1] - c.coefficients @ mean)
        runs = going
    return passes


def _losses(frame: DataFrame, kernels: list[Kernel], points: list[tuple[Margin, np.ndarray, float]], room: int) -> np.ndarray:
    """For (column, coefficients, constant): weighted hinge loss and its gradient by both; one pass."""
    places = sorted({c.kernel for c, _, _ in points})
    groups = [(n, [k for k, p in enumerate(points) if p[0].kernel == place]) for n, place in enumerate(places)]
    slopes, constants = np.stack([p[1] for p in points], axis=1), np.array([p[2] for p in points])
    weights = np.array([p[0].weights for p in points])
    size = len(slopes)

    def add(x: np.ndarray, label: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), size + 2))
        for n, mine in groups:
            rows = inside[:, n]
            z, up = kernels[places[n]].cosines(x[rows]), label[rows, None]
            sign = np.where(up, 1.0, -1.0)
            short = 1.0 - sign * (z @ slopes[:, mine] + constants[mine])
            weight = np.where(up, weights[mine, 1], weights[mine, 0]) * (short > 0)
            pull = -sign * weight
            out[mine] = np.column_stack([(weight * short).sum(0), pull.T @ z, pull.sum(0)])
        return out.ravel()

    return _summed(frame, kernels, places, room, add).reshape(len(points), size + 2)


def margin_scores(frame: DataFrame, kernels: list[Kernel], columns: list[Margin]) -> DataFrame:
    """(candidate, fold, row_id, label, score, prediction) of each row by the columns that left
    it out, from one pass; written once."""
    room = max(1, COSINES // len(kernels[0].offsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, room):
                part = batch.slice(at, room)
                x, fold = _matrix(part), part.column("fold").to_numpy()
                for place, kernel in enumerate(kernels):
                    rows = np.flatnonzero(fold == kernel.without)
                    z = kernel.cosines(x[rows]) if len(rows) else None
                    for c in columns:
                        if c.kernel != place or z is None:
                            continue
                        score = z @ c.coefficients + c.intercept
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), c.candidate, np.int32)), pa.array(np.full(len(rows), kernel.without, np.int32))]
                            + [part.column(name).take(pa.array(rows)) for name in ("row_id", "label")]
                            + [pa.array(score), pa.array((score > 0).astype(float))],
                            names=["candidate", "fold", "row_id", "label", "score", "prediction"],
                        )

    kind = frame.schema["row_id"].dataType.simpleString()
    return cut_lineage(frame.mapInArrow(run, f"candidate int, fold int, row_id {kind}, label double, score double, prediction double"))


@dataclass
class MarginFits:
    kernels: list[Kernel]
    columns: list[Margin]
    scored: DataFrame
    passes: int


def cross_margins(
    rows: DataFrame,
    candidates: Sequence[tuple[ModelSpec, float]],
    key: str = "row_id",
    seed: int = 19,
    sampler: EditedNearestNeighbours | None = None,
    components: int = 256,
    maxIter: int | None = 50,
    kernel_seed: int = 1,
) -> MarginFits:
    """All margin candidates over the same folds; they may differ in features, selection, weights
    and cost. With ``maxIter`` None every fit runs until it has converged.

    ``sampler.by_fold(encoded, kernels)`` gives the rows with an array ``kept``: for each kernel,
    whether the row stays among its training rows. It is asked where the models are under-sampled.
    """
    specs = [s for s, _ in candidates]
    if any(s.kind != "rbf" for s in specs) or len({s.folds for s in specs}) > 1 or len({s.undersample for s in specs}) > 1:
        raise ValueError("shared fits are for margin models with the same folds, all of them under-sampled or none")
    numeric = list(dict.fromkeys(c for s in specs for c in s.numeric))
    categorical = list(dict.fromkeys(c for s in specs for c in s.categorical))
    encoded = encode_once(rows, numeric, categorical, specs[0].folds, key, seed)
    shape = lambda s: (s.columns, s.select, s.drop_first)
    shapes = {shape(s): s for s in specs}
    kernels = views(encoded, list(shapes.values()))
    frame = encoded.frame if sampler is None or not specs[0].undersample else sampler.by_fold(encoded, kernels)
    draw_kernels(frame, kernels, components, kernel_seed)
    order = list(shapes)
    columns = [
        Margin(number, order.index(shape(spec)) * encoded.folds + fold, cost, spec.weights or (1.0, 1.0))
        for number, (spec, cost) in enumerate(candidates)
        for fold in range(encoded.folds)
    ]
    passes = fit_margins(frame, kernels, columns, maxIter)
    return MarginFits(kernels, columns, margin_scores(frame, kernels, columns), passes)


def sweep_margins(
    rows: DataFrame, models: dict[str, ModelSpec], key: str = "row_id", date: str | None = "start_date", seed: int = 19, sampler: EditedNearestNeighbours | None = None, **options
) -> DataFrame:
    """Mean held-out metrics of every model and cost, with and without the excluded spell.

    One line per (model, cost, filter), shaped for the evaluation log. Each filter's models are
    fitted together.
    """
    spark, lines = rows.sparkSession, []
    grid = [(name, spec, cost) for name, spec in models.items() for cost in spec.costs]
    for outside in (True, False) if date else (False,):
        kept = rows
        if outside:
            first, last = (F.lit(d).cast("date") for d in SPELL)
            kept = rows.where((F.col(date) < first) | (F.col(date) > last))
        fits = cross_margins(kept, [(spec, cost) for _, spec, cost in grid], key, seed, sampler, **options)
        found = fold_metrics(fits.scored).groupBy("candidate").agg(*[F.avg(m).alias(m) for m in METRICS])
        for line in sorted(found.collect(), key=lambda r: r["candidate"]):  # one per model and cost
            name, spec, cost = grid[line["candidate"]]
            weights = dict(enumerate(spec.weights)) if spec.weights else None
            lines.append((name, list(spec.columns), weights, *[line[m] for m in METRICS], spec.kind, outside, cost))
    return spark.createDataFrame(lines, SWEEP_COLUMNS)


def grid_margins(
    rows: DataFrame, spec: ModelSpec, costs: Sequence[float], weights: Sequence[tuple[float, float]], key: str = "row_id", seed: int = 19, **options
) -> DataFrame:
    """Mean F1 of every cost and weighting, best first, earlier grid points ahead of equals."""
    points = [(cost, pair) for cost in costs for pair in weights]
    fits = cross_margins(rows, [(replace(spec, weights=pair), cost) for cost, pair in points], key, seed, **options)
    means = class_metrics(fits.scored, keys=["candidate", "fold"]).groupBy("candidate").agg(F.avg("f1").alias("f1"))
    grid = rows.sparkSession.createDataFrame(
        [(i, float(c), float(w[0]), float(w[1])) for i, (c, w) in enumerate(points)],
        "candidate int, c double, weight_0 double, weight_1 double",
    )
    return grid.join(means, "candidate").orderBy(F.desc("f1"), "candidate")
