"""Exact nearest rows by a tree of cells that vectors are routed through.

Every level of the tree splits a cell around at most ``FAN`` pivots sampled from its vectors,
until cells hold about ``block_rows`` of them. A vector first searches its own block of its
own cell; the distance of the last neighbour found there is its radius. It then travels down
the tree to those cells only that the triangle inequality leaves within its radius. Pivots
are rows of a frame beside the vectors they split, so neither the driver nor a closure holds
them, and their number follows the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.session import cut_lineage

BLOCK_ROWS = 20_000
#: Pivots that one cell is split around.
FAN = 64
#: Rows compared at a time, distances of the product form and exact ones held at a time.
CHUNK, PRODUCTS, PAIRS = 512, 1_000_000, 100_000
#: Cells whose sizes go to every task, 16 bytes each; beyond it they are joined by shuffle.
BROADCAST_CELLS = 1_000_000
#: Rounding of a squared distance in the product form, as a part of the squared lengths.
ROUNDING = 1e-12

NEAR = "array<struct<gap:double,row_id:bigint,label:double>>"


def copies(points: DataFrame, members: int) -> DataFrame:
    """One row per distinct vector with the smallest of its rows as (id, label).

    The limit per vector is applied before the shuffle, so any number of equal rows moves
    only a few per task.
    """
    smallest = Window.partitionBy("vector").orderBy("row_id")
    few = points.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= members)
    return few.groupBy("vector").agg(
        F.min("row_id").alias("vector_id"), F.sort_array(F.collect_list(F.struct("row_id", "label"))).alias("members")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _squared(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances in the product form, and how far rounding can have moved them."""
    lengths = (rows**2).sum(1)[:, None] + (others**2).sum(1)[None, :]
    return np.maximum(lengths - 2.0 * rows @ others.T, 0.0), ROUNDING * lengths


def _steps(rows: np.ndarray, others: np.ndarray) -> list[slice]:
    """Parts of ``rows`` to compare with ``others`` at a time, at most ``PRODUCTS`` distances each."""
    size = max(1, min(CHUNK, PRODUCTS // max(1, len(others))))
    return [slice(start, start + size) for start in range(0, len(rows), size)]


def _beside(left: DataFrame, right: DataFrame, *keys: str):
    """Both sides grouped for one task per key; the right one's columns get names of their own first."""
    apart = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(apart.groupBy(*keys))


def _sizes(frame: DataFrame, block_rows: int) -> DataFrame:
    """(cell, parts): the number of blocks that a cell's rows are dealt to."""
    sizes = frame.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts"))
    sizes = cut_lineage(sizes)
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes


def _dealt(frame: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """Rows of a cell dealt to its blocks by their id, so a large cell is many tasks."""
    return frame.join(sizes, "cell").withColumn(name, F.pmod(F.xxhash64("vector_id"), "parts").cast("int")).drop("parts")


def _placed(cells: pa.Table, pivots: pa.Table) -> pa.Table:
    """The vectors of a block with their nearest pivot's cell and their distance from it."""
    rows, others, ids = _matrix(cells), _matrix(pivots), _numbers(pivots, "child")
    order = np.argsort(ids)
    others, ids = others[order], ids[order]
    nearest = np.zeros(len(rows), dtype=np.int64)
    for some in _steps(rows, others):
        nearest[some] = _squared(rows[some], others)[0].argmin(1)
    gaps = np.sqrt(((rows - others[nearest]) ** 2).sum(1)) if len(rows) else np.zeros(0)
    columns = [cells.column("vector_id"), cells.column("vector"), cells.column("members"), pa.array(ids[nearest]), pa.array(gaps)]
    return pa.table(columns, names=["vector_id", "vector", "members", "cell", "gap"])


def grow(distinct: DataFrame, total: int, block_rows: int, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """The vectors by cell, and for each level of the tree (cell, child, vector, radius)."""
    placed = distinct.select("vector_id", "vector", "members", F.lit(0).cast("long").alias("cell"))
    schema = T.StructType([*placed.schema.fields[:3], T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())])
    levels, reached = [], 1
    while reached * block_rows < total:
        sizes = _sizes(placed, block_rows)
        first = Window.partitionBy("cell").orderBy(F.xxhash64("vector_id"), "vector_id")
        chosen = placed.select("cell", "vector_id", "vector").withColumn("place", F.row_number().over(first))
        pivots = cut_lineage(
            chosen.where(F.col("place") <= fan)
            .join(sizes, "cell")
            .where(F.col("place") <= F.col("parts"))
            .select("cell", (F.col("cell") * fan + F.col("place") - 1).alias("child"), "vector", "parts")
        )
        shown = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        pairs = _beside(_dealt(placed, sizes, "part"), shown, "cell", "part")
        placed = cut_lineage(pairs.applyInArrow(_placed, schema))
        radii = placed.groupBy(F.col("cell").alias("child")).agg(F.max("gap").alias("radius"))
        levels.append(cut_lineage(pivots.drop("parts").join(radii, "child")))
        placed, reached = placed.drop("gap"), reached * fan
    return placed, levels


def _sent(asking: pa.Table, children: pa.Table) -> pa.Table:
    """Each asking vector once for every child cell that can hold a row within its radius."""
    rows, others = _matrix(asking), _matrix(children)
    cells, radius, reach = _numbers(children, "child"), _numbers(children, "radius"), _numbers(asking, "reach")
    who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some in _steps(rows, others) if len(others) else ():
        squared, error = _squared(rows[some], others)
        least = np.sqrt(np.maximum(squared - error, 0.0)) - radius[None, :]
        i, j = np.nonzero(least <= reach[some, None] * (1 + 1e-9))
        who.append(i + some.start)
        where.append(j)
    found = asking.select(["vector_id", "vector", "reach", "own"]).take(pa.array(np.concatenate(who)))
    return found.append_column("cell", pa.array(cells[np.concatenate(where)].astype(np.int64)))


def route(asking: DataFrame, levels: list[DataFrame], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vector_id, vector, reach, own, cell): the cells each vector has to be compared with.

    ``asking`` has (vector_id, vector, reach, own); the tree is walked a level at a time, so a
    vector never meets the cells below one that its radius rules out.
    """
    sent = asking.select("vector_id", "vector", "reach", "own", F.lit(0).cast("long").alias("cell"))
    schema = T.StructType([*sent.schema.fields[:4], T.StructField("cell", T.LongType())])
    for children in levels:
        sizes = _sizes(sent, block_rows)
        shown = children.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = _beside(_dealt(sent, sizes, "part"), shown.drop("parts"), "cell", "part")
        sent = cut_lineage(pairs.applyInArrow(_sent, schema))
    return sent


def _compared(rows: np.ndarray, others: np.ndarray, sizes: np.ndarray, ids: np.ndarray, members: int):
    """(row, gap, member) of the nearest ``members`` rows of each of ``rows``, in order.

    ``sizes`` are the rows behind each other vector, ``ids`` their keys one after another.
    """
    first = np.cumsum(sizes) - sizes
    for some in _steps(rows, others):
        part, start = rows[some], some.start
        rough, error = _squared(part, others)
        size = min(members, len(others))
        edge = np.partition(rough + error, size - 1, axis=1)[:, size - 1]
        # The product form only screens; ties and near ties are all measured exactly.
        close = rough - error <= edge[:, None]
        ahead = np.cumsum(close.sum(1))
        for run in np.split(np.arange(len(part)), np.flatnonzero(np.diff(ahead // PAIRS)) + 1):
            i, j = np.nonzero(close[run])
            gap = np.sqrt(((others[j] - part[run][i]) ** 2).sum(1))
            held = sizes[j]
            at = np.repeat(first[j] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            i, gap = np.repeat(i, held), np.repeat(gap, held)
            order = np.lexsort((ids[at], gap, i))
            i, gap, at = i[order], gap[order], at[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < members
            yield run[i[kept]] + start, gap[kept], at[kept]


def _nearest(members: int):
    """For each asking vector of a pair of blocks, its nearest rows in the other block."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], NEAR_TYPE)], names=["vector_id", "near"])
        groups = held.column("members").combine_chunks()
        ids, labels = (pc.struct_field(groups.flatten(), name) for name in ("row_id", "label"))
        sizes = groups.value_lengths().to_numpy().astype(np.int64)
        found = list(_compared(_matrix(asking), _matrix(held), sizes, ids.to_numpy(), members))
        row, gap, at = (np.concatenate(parts) for parts in zip(*found, strict=True))
        ends = np.cumsum(np.bincount(row, minlength=asking.num_rows))
        places = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        at = pa.array(at)
        near = pa.StructArray.from_arrays([pa.array(gap), ids.take(at), labels.take(at)], fields=list(NEAR_TYPE.value_type))
        return pa.table([asking.column("vector_id"), pa.ListArray.from_arrays(places, near, type=NEAR_TYPE)], names=["vector_id", "near"])

    return run


def _edges(far: np.ndarray, outside: np.ndarray, floors: np.ndarray, members: int) -> np.ndarray:
    """For each row of ``far``, a squared distance beyond which no fold's nearest ``members`` lie.

    ``outside`` counts the rows behind each vector that each fold is fitted on; a fold's squared
    distances are at least its floor's part of those in ``far``.
    """
    edges, left, size = np.full(len(far), np.inf), np.arange(len(far)), 4 * members
    while len(left):
        size = min(size, far.shape[1])
        some = far[left]
        near = np.argpartition(some, size - 1, axis=1)[:, :size]
        gaps = np.take_along_axis(some, near, 1)
        order = gaps.argsort(1)
        near, gaps = np.take_along_axis(near, order, 1), np.take_along_axis(gaps, order, 1)
        enough = outside[near].cumsum(1) >= members  # rows x vectors x folds
        done = enough[:, -1].all(1)
        last = np.take_along_axis(gaps, enough.argmax(1), 1) / floors
        edges[left[done]] = last[done].max(1)
        if size == far.shape[1]:
            break  # too few rows for some fold, so all of them are asked
        left, size = left[~done], 4 * size
    return edges


def _nearest_outside(folds: list[int], ratios: np.ndarray, members: int):
    """For each asking vector and each of ``folds``, the nearest rows of other folds in a block."""
    floors = ratios.min(1)

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), 0, np.zeros(0), np.zeros(0, np.int64))]
        if asking.num_rows and held.num_rows:
            groups = held.column("members").combine_chunks()
            ids, labels, own = (pc.struct_field(groups.flatten(), name) for name in ("row_id", "label", "fold"))
            keys, dealt = ids.to_numpy(), own.to_numpy()
            sizes = groups.value_lengths().to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            outside = np.add.reduceat((dealt[:, None] != np.array(folds)).astype(np.int64), first, axis=0)
            rows, others = _matrix(asking), _matrix(held)
            for some in _steps(rows, others):
                part = rows[some]
                rough, error = _squared(part, others)
                close = rough - error <= _edges(rough + error, outside, floors, members)[:, None] * (1 + 1e-9)
                ahead = np.cumsum(close.sum(1))
                for few in np.split(np.arange(len(part)), np.flatnonzero(np.diff(ahead // PAIRS)) + 1):
                    i, j = np.nonzero(close[few])
                    steps = (others[j] - part[few][i]) ** 2
                    held_by = sizes[j]
                    at = np.repeat(first[j] - (np.cumsum(held_by) - held_by), held_by) + np.arange(held_by.sum())
                    i = np.repeat(i, held_by)
                    for fold, ratio in zip(folds, ratios):
                        gap = np.repeat(np.sqrt((steps * ratio).sum(1)), held_by)
                        mine = np.flatnonzero(dealt[at] != fold)
                        order = mine[np.lexsort((keys[at[mine]], gap[mine], i[mine]))]
                        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < members]
                        found.append((few[i[order]] + some.start, fold, gap[order], at[order]))
        # One list for each vector and fold.
        row, gap, at = (np.concatenate([f[k] for f in found]) for k in (0, 2, 3))
        fold = np.repeat([f[1] for f in found], [len(f[0]) for f in found])
        order = np.lexsort((fold, row))
        row, fold, gap, at = row[order], fold[order], gap[order], at[order]
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(fold) != 0)])) if len(row) else np.zeros(0, np.int64)
        places = pa.array(np.append(opens, len(row)).astype(np.int32))
        if len(row):
            at = pa.array(at)
            near = pa.StructArray.from_arrays([pa.array(gap), ids.take(at), labels.take(at)], fields=list(NEAR_TYPE.value_type))
        else:
            near = pa.array([], NEAR_TYPE.value_type)
        columns = [asking.column("vector_id").take(pa.array(row[opens])), pa.array(fold[opens].astype(np.int32))]
        return pa.table([*columns, pa.ListArray.from_arrays(places, near, type=NEAR_TYPE)], names=["vector_id", "without", "near"])

    return run


NEAR_TYPE = pa.list_(pa.struct([("gap", pa.float64()), ("row_id", pa.int64()), ("label", pa.float64())]))


def nearest_rows(
    points: DataFrame, k: int = 3, block_rows: int = BLOCK_ROWS, skip: float | None = None, fan: int = FAN
) -> DataFrame:
    """The ``k`` nearest other rows of every row: (row_id, label, near), exact.

    ``points`` has (row_id, label, vector), the vector an array of doubles. Ties go to the
    smaller id. Equal vectors are searched once. Rows labelled ``skip`` are found by others
    but do not ask, and are not in the result.
    """
    members = k + 1  # a row is among its own nearest rows
    distinct = cut_lineage(copies(points, members))
    total = distinct.count()
    placed, levels = grow(distinct, total, block_rows, fan)
    blocked = cut_lineage(_dealt(placed, _sizes(placed, block_rows), "part"))
    # A full list of members may leave out rows, so such a vector asks whatever it lists.
    asks = F.lit(True)
    if skip is not None:
        asks = F.exists("members", lambda m: m["label"] != F.lit(skip)) | (F.size("members") >= members)
    asking = blocked.where(asks).select("vector_id", "vector", F.col("cell").alias("own_cell"), F.col("part").alias("own"))
    mine = asking.select("vector_id", "vector", F.col("own_cell").alias("cell"), F.col("own").alias("part"))
    schema = f"vector_id long, near {NEAR}"
    found = _beside(mine, blocked, "cell", "part").applyInArrow(_nearest(members), schema)
    if levels or total > block_rows:
        found = cut_lineage(found)
        last = F.when(F.size("near") >= members, F.element_at("near", -1)["gap"]).otherwise(F.lit(float("inf")))
        asked = asking.join(found.select("vector_id", last.alias("reach")), "vector_id")
        sent = route(asked.select("vector_id", "vector", "reach", "own"), levels, block_rows)
        homes = asking.select("vector_id", "own_cell")
        found = found.unionByName(_elsewhere(sent.join(homes, "vector_id"), blocked, block_rows, _nearest(members), schema))
    # A handful of rows per block reached and vector.
    merged = found.groupBy("vector_id").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, members).alias("near")
    )
    vectors = distinct.select("vector", "vector_id").join(merged, "vector_id").drop("vector_id")
    others = F.filter("near", lambda n: n["row_id"] != F.col("row_id"))
    rows = points if skip is None else points.where(F.col("label") != F.lit(skip))
    return rows.join(vectors, "vector").select("row_id", "label", F.slice(others, 1, k).alias("near"))


def nearest_outside(
    points: DataFrame, folds: list[int], ratios: np.ndarray, k: int = 3, block_rows: int = BLOCK_ROWS, skip: float | None = None, fan: int = FAN
) -> DataFrame:
    """(row_id, label, without, near): of ``folds``, for each that a row is not in, its ``k``
    nearest other rows that are not in it either, exact; one search for all of them.

    ``points`` has (row_id, label, fold, vector). A fold has a metric of its own: column j of a
    squared distance counts by ``ratios[fold, j]``, above 0 and at most 1. The search runs in the
    unweighted one, where a fold's nearest rows lie within its radius over the root of its least
    ratio. Ties go to the smaller id; rows labelled ``skip`` are found but do not ask.
    """
    members = k + 1
    same = Window.partitionBy("vector", "fold").orderBy("row_id")
    few = points.withColumn("place", F.row_number().over(same)).where(F.col("place") <= members)
    behind = F.sort_array(F.collect_list(F.struct("row_id", "label", "fold"))).alias("members")
    distinct = cut_lineage(few.groupBy("vector").agg(F.min("row_id").alias("vector_id"), behind))
    total = distinct.count()
    placed, levels = grow(distinct, total, block_rows, fan)
    blocked = cut_lineage(_dealt(placed, _sizes(placed, block_rows), "part"))
    asks = F.lit(True)
    if skip is not None:
        asks = F.exists("members", lambda m: m["label"] != F.lit(skip)) | (F.size("members") >= members)
    asking = blocked.where(asks).select("vector_id", "vector", F.col("cell").alias("own_cell"), F.col("part").alias("own"))
    mine = asking.select("vector_id", "vector", F.col("own_cell").alias("cell"), F.col("own").alias("part"))
    search, schema = _nearest_outside(folds, ratios, members), f"vector_id long, without int, near {NEAR}"
    found = _beside(mine, blocked, "cell", "part").applyInArrow(search, schema)
    if levels or total > block_rows:
        found = cut_lineage(found)
        floors = F.create_map(*[F.lit(v) for fold, ratio in zip(folds, ratios) for v in (fold, float(np.sqrt(ratio.min())))])
        last = F.when(F.size("near") >= members, F.element_at("near", -1)["gap"] / floors[F.col("without")])
        # A fold that found too few rows here has to look everywhere.
        whole = (F.count(last) == len(folds)) & (F.count(F.lit(1)) == len(folds))
        reach = F.when(whole, F.max(last)).otherwise(F.lit(float("inf")))
        reached = found.groupBy("vector_id").agg(reach.alias("reach"))
        asked = asking.join(reached, "vector_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        sent = route(asked.select("vector_id", "vector", "reach", "own"), levels, block_rows)
        homes = asking.select("vector_id", "own_cell")
        found = found.unionByName(_elsewhere(sent.join(homes, "vector_id"), blocked, block_rows, search, schema))
    merged = found.groupBy("vector_id", "without").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, members).alias("near")
    )
    vectors = distinct.select("vector", "vector_id").join(merged, "vector_id").drop("vector_id")
    others = F.filter("near", lambda n: n["row_id"] != F.col("row_id"))
    rows = points if skip is None else points.where(F.col("label") != F.lit(skip))
    met = rows.join(vectors, "vector").where(F.col("fold") != F.col("without"))
    return met.select("row_id", "label", "without", F.slice(others, 1, k).alias("near"))


def _elsewhere(sent: DataFrame, blocked: DataFrame, block_rows: int, search, schema: str) -> DataFrame:
    """What ``search`` finds in the blocks that vectors were sent to, their own block left out."""
    widths = _sizes(blocked, block_rows)
    asked = _sizes(sent, block_rows).withColumnRenamed("parts", "asked")
    away = (F.col("cell") != F.col("own_cell")) | (F.col("part") != F.col("own"))
    keys = ["cell", "ask_part", "part"]
    asking = (
        _dealt(sent, _sizes(sent, block_rows), "ask_part")
        .join(widths, "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where(away)
        .select(*keys, "vector_id", "vector")
    )
    held = (
        blocked.join(asked, "cell")
        .withColumn("ask_part", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
        .select(*keys, "vector", "members")
    )
    return _beside(asking, held, *keys).applyInArrow(search, schema)
