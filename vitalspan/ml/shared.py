"""Cross-validation whose folds and candidates share their passes over the data.

Rows are encoded and dealt to folds once and written. One pass then gives counts, sums and
squares per (fold, label, feature), from which every fold's statistics follow as the total less
the fold's own cell. Fits advance together: a pass evaluates loss, gradient and second derivatives of all
(candidate, fold) columns, each of which then takes a Newton step, and columns that have
converged leave. A last pass scores each row by the columns that have not seen it.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.ml.cv import METRICS, SWEEP_COLUMNS, stratified_folds
from vitalspan.ml.evaluate import class_metrics, roc_auc
from vitalspan.ml.specs import ModelSpec
from vitalspan.plans.training import SPELL
from vitalspan.session import cut_lineage


def identified(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """``rows`` with a key that is unique and the same in every run.

    The key is a digest of all columns, NULL told from text, and a number among equal rows.
    Equal rows are counted before they are numbered, so no task holds them all. Columns of a
    map type cannot be compared and are an error.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in map(F.col, rows.columns)]
    numbered = counted.select(*rows.columns, F.md5(F.concat_ws("|", *parts)).alias("__d"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__k"))
    return numbered.select(F.concat_ws("-", "__d", F.col("__k").cast("string")).alias(name), *rows.columns)


@dataclass
class Encoded:
    """Rows with key, label, fold and an array of features, written once."""

    frame: DataFrame
    names: list[str]
    numeric: int
    folds: int
    units: list[float]  # what each number was divided by

    def mask(self, columns: Sequence[str]) -> np.ndarray:
        """Which features come from the columns named."""
        wanted = set(columns)
        return np.array([name.split("\0")[0] in wanted for name in self.names])

    def shown(self, k: int) -> str:
        return self.names[k].replace("\0", "_")


def _one_hot(text, levels: Sequence[str]):
    return F.transform(F.array(*map(F.lit, levels)).cast("array<string>"), lambda x: F.coalesce((x == text).cast("double"), F.lit(0.0)))


def encode_once(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: int, key: str = "row_id", seed: int = 19) -> Encoded:
    """Numbers shifted and scaled by their overall mean and deviation, and one 0/1 feature for
    each level of a category, levels in order; a NULL category is all zeros.

    The overall scaling only keeps later sums exact; what a fold's own scaler would do is
    applied to its coefficients. Levels are collected, as any one-hot encoder does.
    """
    moments = [f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = rows.agg(F.count(F.lit(1)), *moments).first()
    values = [(F.col(c).cast("double") - F.lit(found[f"m{i}"] or 0.0)) / F.lit(found[f"s{i}"] or 1.0) for i, c in enumerate(numeric)]
    features, names = [F.array(*values).cast("array<double>")], list(numeric)
    for c in categorical:
        levels = sorted(r[0] for r in rows.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().collect())
        names += [f"{c}\0{level}" for level in levels]
        features.append(_one_hot(F.col(c).cast("string"), levels))
    folded = stratified_folds(rows, key, k=folds, seed=seed)
    frame = folded.select(F.col(key).alias("row_id"), F.col("label").cast("double").alias("label"), "fold", F.concat(*features).alias("features"))
    return Encoded(cut_lineage(frame), names, len(numeric), folds, [found[f"s{i}"] or 1.0 for i in range(len(numeric))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("features")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def cells(encoded: Encoded) -> DataFrame:
    """(fold, label, feature, n, s, q): count, sum and squares of every feature, from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x, fold, label = _matrix(batch), batch.column("fold").to_numpy(), batch.column("label").to_numpy()
            for f in np.unique(fold):
                for y in np.unique(label):
                    part = x[(fold == f) & (label == y)]
                    if len(part):
                        sums = np.stack([np.full(x.shape[1], float(len(part))), part.sum(0), (part * part).sum(0)])
                        held[int(f), float(y)] = held.get((int(f), float(y)), 0) + sums
        for (f, y), sums in held.items():
            size = sums.shape[1]
            columns = [pa.array([f] * size, pa.int32()), pa.array([y] * size), pa.array(range(size), pa.int32()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "label", "feature", "n", "s", "q"])

    parts = encoded.frame.mapInArrow(run, "fold int, label double, feature int, n double, s double, q double")
    return parts.groupBy("fold", "label", "feature").agg(*[F.sum(c).alias(c) for c in "nsq"])


def left_out(found: DataFrame, folds: int) -> DataFrame:
    """Each fold's training cells (without, label, feature, n, s, q): all folds less its own."""
    every = found.groupBy("label", "feature").agg(*[F.sum(c).alias(c) for c in "nsq"])
    every = every.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    own = found.select(F.col("fold").alias("without"), "label", "feature", *[F.col(c).alias(f"own_{c}") for c in "nsq"])
    rest = every.join(own, ["without", "label", "feature"], "left")
    return rest.select("without", "label", "feature", *[(F.col(c) - F.coalesce(f"own_{c}", F.lit(0.0))).alias(c) for c in "nsq"]).where("n > 0.5")


def fold_anova(rest: DataFrame) -> DataFrame:
    """(without, feature, f_value) of a one-way ANOVA over each fold's training rows; NULL for
    a feature that is constant there."""
    sums = rest.groupBy("without", "feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("s").alias("s"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("means"),
        F.sum("q").alias("q"),
    )
    between = (F.col("means") - F.col("s") * F.col("s") / F.col("n")) / (F.col("groups") - 1)
    within = (F.col("q") - F.col("means")) / (F.col("n") - F.col("groups"))
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    value = F.when((spread > 1e-9 * F.col("n")) & (within > 0), between / within)
    return sums.select("without", "feature", value.alias("f_value"))


def fold_scalers(rest: DataFrame) -> DataFrame:
    """(without, feature, mean, deviation) over each fold's training rows."""
    sums = rest.groupBy("without", "feature").agg(*[F.sum(c).alias(c) for c in "nsq"])
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("without", "feature", mean.alias("mean"), F.when(spread > 1e-9, spread).otherwise(1.0).alias("deviation"))


def best_per_fold(rest: DataFrame, k: int) -> DataFrame:
    """(without, feature) of the ``k`` features with the largest F, the first of equals."""
    order = Window.partitionBy("without").orderBy(F.col("f_value").desc_nulls_last(), "feature")
    return fold_anova(rest).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("without", "feature")


@dataclass
class Column:
    """One logistic fit: cost, weights of labels 0 and 1, the fold it leaves out, its features."""

    cost: float
    weights: tuple[float, float]
    without: int
    mask: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    coefficients: np.ndarray | None = None
    intercept: float = 0.0
    passes: int = 0

    def spread(self, point: np.ndarray) -> np.ndarray:
        """Weights of the column's own features as weights of all, the constant last."""
        whole = np.zeros(len(self.mask) + 1)
        whole[:-1][self.mask], whole[-1] = point[:-1], point[-1]
        return whole

    def flat(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and constant that act on features as they are stored."""
        slopes = np.where(self.mask, point[:-1] / self.deviation, 0.0)
        return slopes, point[-1] - float(slopes @ self.mean)


#: Numbers of all columns' second derivatives that one pass sums up at most.
CURVATURES = 8_000_000


def _newton(size: int, tolerance: float, most: int) -> Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], np.ndarray]:
    """Minimise a smooth strictly convex function whose values, gradients and second derivatives
    are sent in. A step is shortened until it lowers the value enough."""
    x = np.zeros(size)
    value, slope, curve = yield x
    for _ in range(most):
        if np.abs(slope).max() <= tolerance:
            break
        # What rounding leaves of a flat direction must not make the step long.
        way = -np.linalg.solve(curve + 1e-14 * max(np.trace(curve), 1e-300) / size * np.eye(size), slope)
        fall = slope @ way
        if fall >= 0:
            way, fall = -slope, -(slope @ slope)
        length = 1.0
        for _ in range(40):
            new = yield x + length * way
            if new[0] <= value + 1e-4 * length * fall:
                break
            # The lowest point of the parabola through what is known, within bounds.
            bend = new[0] - value - length * fall
            length *= min(0.5, max(0.1, -0.5 * length * fall / bend)) if bend > 0 else 0.5
        else:
            break  # no progress that doubles could show
        x = x + length * way
        value, slope, curve = new
    return x


def _evaluate(frame: DataFrame, runs: Sequence[tuple[Column, np.ndarray, float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For (column, slopes, constant): loss, gradient and second derivatives by the column's own
    features as they are stored, then by the constant; one pass.

    Each task sums its rows, and there are no more tasks than cores, as every one hands on the
    sums of all columns; these are added up by column.
    """
    slopes, constants = np.stack([r[1] for r in runs], axis=1), np.array([r[2] for r in runs])
    weights, without = np.array([r[0].weights for r in runs]), np.array([r[0].without for r in runs])
    used = [np.flatnonzero(r[0].mask) for r in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray | None] = [None] * len(used)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, label, fold = _matrix(part), part.column("label").to_numpy(), part.column("fold").to_numpy()
                margin = x @ slopes + constants
                weight = np.where(label[:, None] == 1, weights[:, 1], weights[:, 0]) * (fold[:, None] != without)
                loss = (weight * np.logaddexp(0.0, np.where(label[:, None] == 1, -margin, margin))).sum(0)
                chance = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                pull, bend = weight * (chance - (label[:, None] == 1)), weight * chance * (1.0 - chance)
                known: dict[bytes, np.ndarray] = {}
                for k, places in enumerate(used):
                    mine = known.get(places.tobytes())
                    if mine is None:
                        mine = known[places.tobytes()] = np.column_stack([x[:, places], np.ones(len(x))])
                    found = np.concatenate([loss[k : k + 1], mine.T @ pull[:, k], ((mine * bend[:, k, None]).T @ mine).ravel()])
                    sums[k] = found if sums[k] is None else sums[k] + found
        for k, found in enumerate(sums):
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found], pa.list_(pa.float64()))], names=["column", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v.values) for v in table.column("sums")], axis=0)
        return pa.table([table.column("column").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], names=["column", "sums"])

    kind = "column int, sums array<double>"
    rows = frame.select("label", "fold", "features").coalesce(frame.sparkSession.sparkContext.defaultParallelism)
    summed = rows.mapInArrow(run, kind).groupBy("column").applyInArrow(added, kind)
    out: list[tuple[float, np.ndarray, np.ndarray]] = [(0.0, np.zeros(len(p) + 1), np.zeros((len(p) + 1,) * 2)) for p in used]
    for row in summed.toArrow().to_batches():  # a row per column, whatever the rows
        for k, values in zip(row.column("column").to_pylist(), row.column("sums")):
            flat, size = np.asarray(values.values), len(used[k]) + 1
            out[k] = (float(flat[0]), flat[1 : 1 + size], flat[1 + size :].reshape(size, size))
    return out


def fit_columns(encoded: Encoded, columns: list[Column], totals: dict[int, tuple[float, float]], tolerance: float = 1e-8, most: int = 500) -> int:
    """Fit every column by Newton steps, all in the same passes; the number of passes.

    Each minimises cost x weighted loss + half the squared norm, intercept free, over the rows
    outside its fold; ``totals`` has those rows' count for labels 0 and 1. Columns whose second
    derivatives are more than ``CURVATURES`` numbers together take turns.
    """
    turns: list[list[Column]] = []
    room = 0
    for c in columns:
        need = (int(c.mask.sum()) + 1) ** 2
        if not turns or need > room:
            turns.append([])
            room = CURVATURES
        turns[-1].append(c)
        room -= need
    return sum(_fit_together(encoded, some, totals, tolerance, most) for some in turns)


def _fit_together(encoded: Encoded, columns: list[Column], totals: dict[int, tuple[float, float]], tolerance: float, most: int) -> int:
    runs = []
    for c in columns:
        size = c.weights[0] * totals[c.without][0] + c.weights[1] * totals[c.without][1]
        run = _newton(int(c.mask.sum()) + 1, tolerance, most)
        runs.append((c, run, next(run), max(size, 1e-300)))
    passes = 0
    while runs:
        found = _evaluate(encoded.frame, [(c, *c.flat(c.spread(point))) for c, _, point, _ in runs])
        passes += 1
        going = []
        for (c, run, point, size), (loss, pulls, bends) in zip(runs, found):
            norm = 1.0 / (c.cost * size)
            mean, deviation = c.mean[c.mask], c.deviation[c.mask]
            # Stored features less the fold's mean, by its deviation, are the fold's own.
            turn = np.zeros((len(mean) + 1, len(mean) + 1))
            turn[np.arange(len(mean)), np.arange(len(mean))] = 1.0 / deviation
            turn[:-1, -1], turn[-1, -1] = -mean / deviation, 1.0
            ridge = norm * np.append(np.ones(len(mean)), 0.0)
            value = loss / size + 0.5 * norm * float(point[:-1] @ point[:-1])
            slope = turn @ pulls / size + ridge * point
            curve = turn @ bends @ turn.T / size + np.diag(ridge)
            c.passes = passes
            try:
                going.append((c, run, run.send((value, slope, curve)), size))
            except StopIteration as done:
                whole = c.spread(done.value)
                c.coefficients, c.intercept = whole[:-1], float(whole[-1])
        runs = going
    return passes


def held_out_scores(encoded: Encoded, columns: list[Column], candidates: Sequence[int]) -> DataFrame:
    """(candidate, fold, row_id, label, score, prediction) of each row by the columns that left
    it out, from one pass; written once."""
    flat = [c.flat(np.append(c.coefficients, c.intercept)) for c in columns]
    slopes, constants = np.stack([f[0] for f in flat], axis=1), np.array([f[1] for f in flat])
    without, number = np.array([c.without for c in columns]), np.array(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                margin = _matrix(part) @ slopes + constants
                row, column = np.nonzero(part.column("fold").to_numpy()[:, None] == without)
                score = margin[row, column]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[column], pa.int32()), pa.array(without[column], pa.int32())]
                    + [part.column(c).take(pa.array(row)) for c in ("row_id", "label")]
                    + [pa.array(score), pa.array((score > 0).astype(float))],
                    names=["candidate", "fold", "row_id", "label", "score", "prediction"],
                )

    kind = encoded.frame.schema["row_id"].dataType.simpleString()
    return cut_lineage(encoded.frame.mapInArrow(run, f"candidate int, fold int, row_id {kind}, label double, score double, prediction double"))


def fold_metrics(scored: DataFrame) -> DataFrame:
    keys = ["candidate", "fold"]
    return class_metrics(scored, keys=keys).join(roc_auc(scored, keys=keys), keys).select(*keys, *METRICS)


@dataclass
class SharedFits:
    encoded: Encoded
    columns: list[Column]
    scored: DataFrame
    passes: int


def cross_fit(rows: DataFrame, candidates: Sequence[tuple[ModelSpec, float]], key: str = "row_id", seed: int = 19) -> SharedFits:
    """All logistic candidates over the same folds; they may differ in features, selection,
    weights and cost."""
    specs = [s for s, _ in candidates]
    if any(s.kind != "lbfgs" or s.undersample or s.drop_first for s in specs) or len({s.folds for s in specs}) > 1:
        raise ValueError("shared fits are for logistic models with the same folds, all levels and all rows")
    numeric = list(dict.fromkeys(c for s in specs for c in s.numeric))
    categorical = list(dict.fromkeys(c for s in specs for c in s.categorical))
    encoded = encode_once(rows, numeric, categorical, specs[0].folds, key, seed)
    rest = cut_lineage(left_out(cells(encoded), encoded.folds))
    size, folds = len(encoded.names), encoded.folds
    mean, deviation = np.zeros((folds, size)), np.ones((folds, size))
    for r in fold_scalers(rest).where(F.col("feature") < encoded.numeric).collect():  # folds x features
        mean[r["without"], r["feature"]], deviation[r["without"], r["feature"]] = r["mean"], r["deviation"]
    counts = {(r["without"], r["label"]): r["n"] for r in rest.where("feature = 0").select("without", "label", "n").collect()}
    totals = {f: (counts.get((f, 0.0), 0.0), counts.get((f, 1.0), 0.0)) for f in range(folds)}

    chosen: dict[tuple, np.ndarray] = {}
    for spec in specs:
        if spec.select and (spec.columns, spec.select) not in chosen:
            usable = [int(k) for k in np.flatnonzero(encoded.mask(spec.columns))]
            masks = np.zeros((folds, size), bool)
            for r in best_per_fold(rest.where(F.col("feature").isin(usable)), spec.select).collect():  # folds x k
                masks[r["without"], r["feature"]] = True
            chosen[spec.columns, spec.select] = masks
    columns, numbers = [], []
    for number, (spec, cost) in enumerate(candidates):
        for fold in range(folds):
            mask = chosen[spec.columns, spec.select][fold] if spec.select else encoded.mask(spec.columns)
            columns.append(Column(cost, spec.weights or (1.0, 1.0), fold, mask, mean[fold], deviation[fold]))
            numbers.append(number)
    passes = fit_columns(encoded, columns, totals)
    return SharedFits(encoded, columns, held_out_scores(encoded, columns, numbers), passes)


def sweep_logistic(rows: DataFrame, models: dict[str, ModelSpec], key: str = "row_id", date: str | None = "start_date", seed: int = 19) -> DataFrame:
    """Mean held-out metrics of every model and cost, with and without the excluded spell.

    One line per (model, cost, filter), shaped for the evaluation log. Each filter's models are
    fitted together, so the data is passed over as often as the slowest of them needs.
    """
    spark, lines = rows.sparkSession, []
    grid = [(name, spec, cost) for name, spec in models.items() for cost in spec.costs]
    for outside in (True, False) if date else (False,):
        kept = rows
        if outside:
            first, last = (F.lit(d).cast("date") for d in SPELL)
            kept = rows.where((F.col(date) < first) | (F.col(date) > last))
        fits = cross_fit(kept, [(spec, cost) for _, spec, cost in grid], key, seed)
        found = fold_metrics(fits.scored).groupBy("candidate").agg(*[F.avg(m).alias(m) for m in METRICS])
        for line in found.collect():  # one per model and cost
            name, spec, cost = grid[line["candidate"]]
            weights = dict(enumerate(spec.weights)) if spec.weights else None
            lines.append((name, list(spec.columns), weights, *[line[m] for m in METRICS], spec.kind, outside, cost))
    return spark.createDataFrame(lines, SWEEP_COLUMNS)


def fit_sigmoids(scored: DataFrame, keys: Sequence[str], tolerance: float = 1e-10, most: int = 100) -> DataFrame:
    """(keys, slope, intercept) of P(1) = 1 / (1 + exp(-(slope x score + intercept))) per group.

    Targets are softened by the group's class sizes. All groups take Newton steps together,
    each step one grouped aggregate over rows that have shrunk to one per (keys, score, label).
    A step is shortened where it would raise the loss; there is one line per group.
    """
    counted = scored.groupBy(*keys, F.col("score").cast("double").alias("score"), (F.col("label") == 1).alias("positive")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("down"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    target = F.when(F.col("positive"), (F.col("up") + 1.0) / (F.col("up") + 2.0)).otherwise(1.0 / (F.col("down") + 2.0))
    rows = cut_lineage(counted.join(sizes, same).select(*keys, "score", "n", target.alias("t")))
    spark = scored.sparkSession
    kinds = [(k, rows.schema[k].dataType) for k in keys]
    points_of = T.StructType([*(T.StructField(f"__{k}", t) for k, t in kinds), T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType())])
    state = {tuple(r): {"at": np.zeros(2), "best": None, "step": np.zeros(2), "rows": r} for r in rows.select(*keys).distinct().collect()}
    going = set(state)
    for _ in range(most):
        if not going:
            break
        points = spark.createDataFrame([(*g, *map(float, state[g]["at"])) for g in going], points_of)
        m = F.col("__a") * F.col("score") + F.col("__b")
        p = 1 / (1 + F.exp(-m))
        loss = F.greatest(m, F.lit(0.0)) - F.col("t") * m + F.log1p(F.exp(-F.abs(m)))
        h = F.col("n") * F.greatest(p * (1 - p), F.lit(1e-12))
        sums = {"f": F.col("n") * loss, "ga": F.col("n") * (p - F.col("t")) * F.col("score"), "gb": F.col("n") * (p - F.col("t")), "aa": h * F.col("score") * F.col("score"), "ab": h * F.col("score"), "bb": h}
        found = rows.join(F.broadcast(points), same).select(*keys, *[e.alias(n) for n, e in sums.items()]).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
        for r in found.collect():  # one per group
            group = tuple(r[k] for k in keys)
            s = state[group]
            if s["best"] is not None and r["f"] > s["best"] + 1e-12 * abs(s["best"]) and np.abs(s["step"]).max() > 1e-12:
                s["step"] = s["step"] / 2
                s["at"] = s["at"] - s["step"]
                continue
            slope = np.array([r["ga"], r["gb"]])
            curve = np.array([[r["aa"], r["ab"]], [r["ab"], r["bb"]]]) + 1e-12 * np.eye(2)
            s["best"], s["step"] = r["f"], -np.linalg.solve(curve, slope)
            if np.abs(s["step"]).max() <= tolerance * (1 + np.abs(s["at"]).max()):
                going.discard(group)
            else:
                s["at"] = s["at"] + s["step"]
    lines = [(*g, float(s["at"][0]), float(s["at"][1])) for g, s in state.items()]
    return spark.createDataFrame(lines, rows.select(*keys).schema.add("slope", "double").add("intercept", "double"))


def calibrated_scores(scored: DataFrame, keys: Sequence[str] = ("candidate", "fold")) -> DataFrame:
    """``scored`` with ``probability_1``: each row's score through the sigmoid of its own fold's
    held-out scores, for any classifier."""
    fits = fit_sigmoids(scored, keys)
    fits = fits.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = scored.join(F.broadcast(fits), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    value = 1 / (1 + F.exp(-(F.col("slope") * F.col("score") + F.col("intercept"))))
    return joined.select(*scored.columns, value.alias("probability_1"))


