"""Near-duplicate embeddings by products of int8 tiles with bounded error.

Vectors of a label are dealt into tiles of bounded size. A pair of tiles is quantised once and
taken as blocks, each a matrix product, so that a tile is shipped once for many products. With x = s q + e and the norm of e known for every vector, the product
is off by at most |s q| |e'| + |e| |s' q'| + |e| |e'|; only pairs that may still reach the
threshold are computed in double precision.

The work is quadratic in the distinct vectors of one label; that is the price of finding every
link by products. Equal vectors of a label are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.links import components
from vitalspan.session import cut_lineage

THRESHOLD = 0.93
#: Vectors of a tile at most, about, and bytes of their components.
TILE, TILE_BYTES = 8192, 16 << 20
#: Vectors of either side of one product.
BLOCK = 1024
_SLACK = 1e-9
_TILE_SCHEMA = "label {label}, dim int, tile long, names binary, counts binary, vectors binary"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, the norms of scaled vectors, and of what they leave out."""
    scale = np.abs(unit).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    whole = q * scale[:, None]
    return q, scale, np.linalg.norm(whole, axis=1), np.linalg.norm(unit - whole, axis=1)


def possible(x: tuple, y: tuple, threshold: float) -> np.ndarray:
    """Which pairs of two quantised tiles may reach the threshold."""
    (q, s, n, e), (r, t, m, f) = x, y
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # exact for integers
    product = q.astype(kind) @ r.astype(kind).T
    most = product * s[:, None] * t + (n[:, None] * f + e[:, None] * (m + f))
    return most >= threshold - _SLACK


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, small: tuple | None = None) -> np.ndarray:
    """The pairs (row of x, row of y) of unit vectors with cosine at or over the threshold.

    ``small`` holds both sides quantised, if they are already.
    """
    maybe = possible(*(small or (quantise(x), quantise(y))), threshold)
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    good = np.zeros(len(i), bool)
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for a in range(0, len(i), step):
        good[a : a + step] = np.einsum("ij,ij->i", x[i[a : a + step]], y[j[a : a + step]]) >= threshold
    return np.stack([i[good], j[good]], 1)


def spanning(pairs: np.ndarray, n: int, m: int, same: bool) -> np.ndarray:
    """A subset of the pairs with the same components and at most n + m members.

    Labels spread from the smallest row until nothing changes; each row keeps the pair that
    gave it its label.
    """
    if not len(pairs):
        return pairs
    a, b = pairs[:, 0], pairs[:, 1] if same else pairs[:, 1] + n
    label = np.arange(n if same else n + m)
    via = np.full(len(label), -1)
    while True:
        old = label.copy()
        for u, v in ((a, b), (b, a)):
            less = np.flatnonzero(label[u] < label[v])
            # The smallest label offered to each row wins.
            order = less[np.lexsort((label[u[less]], v[less]))]
            first = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]])) if len(order) else []
            chosen = order[first]
            label[v[chosen]] = label[u[chosen]]
            via[v[chosen]] = chosen
        if (label == old).all():
            break
    return pairs[np.unique(via[via >= 0])]


def tile_links(x: np.ndarray, y: np.ndarray, counts: np.ndarray, weights: np.ndarray, threshold: float, same: bool, block: int = BLOCK):
    """Links of two tiles: how many each row of x and of y has, and pairs that span them.

    ``counts`` and ``weights`` say how many vectors the rows of x and of y stand for. Only the
    pairs of one product of blocks are held at a time.
    """
    small_x = quantise(x)
    small_y = small_x if same else quantise(y)
    left, right = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    trees = [np.zeros((0, 2), np.int64)]
    for a in range(0, len(x), block):
        for b in range(a if same else 0, len(y), block):
            rows, columns = slice(a, a + block), slice(b, b + block)
            own = same and a == b
            small = tuple(p[rows] for p in small_x), tuple(p[columns] for p in small_y)
            pairs = linked(x[rows], y[columns], threshold, own, small)
            if len(pairs):
                np.add.at(left, a + pairs[:, 0], weights[b + pairs[:, 1]])
                np.add.at(right, b + pairs[:, 1], counts[a + pairs[:, 0]])
                trees.append(spanning(pairs, len(x[rows]), len(y[columns]), own) + np.array([a, b]))
    return left, right, spanning(np.concatenate(trees), len(x), len(y), same)


def _pack(table: pa.Table) -> pa.Table:
    vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    # Scaled by the largest component first, so that no square overflows or vanishes.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return pa.table(
        [
            table.column("label").slice(0, 1),
            table.column("dim").slice(0, 1),
            table.column("tile").slice(0, 1),
            pa.array([table.column("c").to_numpy().astype("<i8").tobytes()]),
            pa.array([table.column("n").to_numpy().astype("<i8").tobytes()]),
            pa.array([vectors.astype("<f8").tobytes()]),
        ],
        names=["label", "dim", "tile", "names", "counts", "vectors"],
    )


def _product(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: E731, B023
                names, others = get("names", "<i8"), get("other_names", "<i8")
                counts, weights = get("counts", "<i8"), get("other_counts", "<i8")
                x, y = get("vectors", "<f8").reshape(len(names), -1), get("other_vectors", "<f8").reshape(len(others), -1)
                same = batch.column("tile")[row].as_py() == batch.column("other")[row].as_py()
                left, right, tree = tile_links(x, y, counts, weights, threshold, same)
                if not len(tree):
                    continue
                found, also = np.flatnonzero(left), np.flatnonzero(right)
                none = lambda k: np.full(k, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([names[found], others[also], names[tree[:, 0]]])),
                        pa.array(np.concatenate([left[found], right[also], none(len(tree))])),
                        pa.array(np.concatenate([none(len(found) + len(also)), others[tree[:, 1]]])),
                    ],
                    names=["a", "n", "b"],
                )

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Rows of one label link when their cosine in double precision is at or over ``threshold``.
    Rows whose label is NULL, and vectors that are NULL, empty, zero or hold NULL or
    non-finite components, link with nothing, nor do vectors of different length. Repeated
    rows count as further vectors. ``component_id`` is the smallest vec_id reachable by links,
    its own included; a NULL vec_id only counts if there is no other. ``kept`` tells whether
    it is the row's own. Further columns are not read; no rows give none. A tile holds about
    ``tile`` vectors, fewer where these would take more than ``TILE_BYTES``.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    good = F.col("label").isNotNull() & F.coalesce(finite & nonzero, F.lit(False))
    rows = rows.withColumn("good", good)
    keyed = F.when(F.col("good"), F.struct("label", "v"))
    rows = rows.select("vec_id", "good", "label", F.when(F.col("good"), F.col("v")).alias("v"), F.xxhash64(keyed).alias("h"))

    classes = rows.where("good").groupBy("label", "h", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = cut_lineage(classes.withColumn("c", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("size"))
    most = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))
    sizes = sizes.select("label", "dim", F.ceil(F.col("size") / most).alias("tiles"))
    units = classes.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"])
    units = units.select("label", "dim", F.pmod(F.xxhash64("c"), "tiles").alias("tile"), "c", "n", "v")
    kind = rows.schema["label"].dataType.simpleString()
    tiles = cut_lineage(units.groupBy("label", "dim", "tile").applyInArrow(_pack, _TILE_SCHEMA.format(label=kind)))

    # Each pair of tiles of a label once: every tile names its partners, then gets their rows.
    pairs = sizes.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "tiles")
    pairs = pairs.select("label", "dim", "tile", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("other"))
    pairs = pairs.repartition("label", "dim", "tile", "other")
    other = tiles.select("label", "dim", F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("names", "counts", "vectors")])
    both = pairs.join(tiles, ["label", "dim", "tile"]).join(other, ["label", "dim", "other"])
    found = cut_lineage(both.select("tile", "other", "names", "counts", "vectors", "other_names", "other_counts", "other_vectors").mapInArrow(_product(threshold), "a long, n long, b long"))

    counts = found.where("n >= 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    groups = components(found.where("n < 0").select("a", "b")).withColumnRenamed("node", "c")
    named = classes.join(counts, "c", "left").join(groups, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # Of a class, each member is linked to the others as well.
    named = named.join(least, "component").select("label", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    made = rows.join(named, ["label", "h", "v"], "left")
    one = F.coalesce("component_id", "vec_id")
    return made.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), one.alias("component_id"), F.coalesce(F.col("vec_id") == one, F.lit(False)).alias("kept"))
