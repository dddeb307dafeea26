"""Jaccard join of word shingles by parity sketches.

A set of n shingle hashes becomes a row of cells: hashes falling into one cell are XORed, so
two sketches differ in at most as many cells as the sets have elements not in common. With
Jaccard similarity of 3/4 or more that is at most a third of either set. Hence, of a sketch
with p filled cells (p over n/3), one filled cell at least is the same in both: cells are the
keys of a pigeonhole join, ordered rarest first, of which only the first n/3 + 1 count. Sets
whose sizes may be similar share a size band, and a band has one number of cells. All
candidates are verified on whole sets.

Texts with the same set are one class from the start, and everything below works on classes.
A class is named by 64 bits of its set's digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.llm.bytewords import SPACED, ByteWords, mix, slices, text_buffer
from vitalspan.llm.links import components
from vitalspan.session import cut_lineage

WORDS = 5
#: Up to this size every element is a cell of its own.
SMALL = 48
BUCKET_KEYS = 500_000
#: Classes of one key that meet in one piece; a key of more makes several pieces.
PIECE = 4_096
#: Classes whose names may be broadcast (8 bytes each); more go through a shuffle join.
BROADCAST_CLASSES = 500_000
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_HEAD = np.dtype([("c", "<i8"), ("n", "<u4"), ("p", "<u4"), ("count", "<u4"), ("band", "u1")])


def shingle_sets(batch: pa.RecordBatch, words: ByteWords, text: str = "text") -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = text_buffer(batch.column(text))
    hashes, _, _, bounds = words.of(data, offsets)
    whole = max(0, len(hashes) - WORDS + 1)
    grams = np.full(whole, WORDS, np.uint64)
    for k in range(WORDS):
        grams += hashes[k : k + whole] * _FACTORS[k]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            short = (hashes[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class(shingles: np.ndarray) -> int:
    """A digest of the set, as a signed 64-bit number."""
    total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total]))[0].view(np.int64))


def _cells(shingles: np.ndarray, cells: int) -> np.ndarray:
    """The filled cells of a sketch: a hash of each one's place and parity."""
    place = ((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    parity = np.bitwise_xor.reduceat(shingles, first)
    return mix(parity + (place[first] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def sketch(shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(band, keys): the set's filled cells in every band in which it may meet a similar set."""
    n = len(shingles)
    if not n:
        return []
    out = []
    if n <= SMALL + SMALL // 3:
        out.append((0, mix(shingles)))
    if n > SMALL:
        band, low = 1, SMALL + 1
        while n >= 2 * low:
            band, low = band + 1, 2 * low
        for b, least in ((band, low), *(((band - 1, low // 2),) if band > 1 and 3 * n <= 4 * low else ())):
            keys = _cells(shingles, least + least // 9)
            out.append((b, mix(keys + np.uint64(b))))
            if len(keys) <= n // 3:
                # All filled cells may differ. A partner with more filled cells is found by its
                # own; two such sets meet element by element.
                out.append((128 + b, mix(shingles + np.uint64(128 + b))))
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = ByteWords(SPACED)
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch, words)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
            names=["doc_id", "c", "n"],
        )


def _packed(bucket: np.ndarray, owner: np.ndarray, heads: np.ndarray, *values: np.ndarray):
    """Entries grouped by bucket, then owner: (bucket, heads, values) as bytes."""
    order = np.lexsort((owner, bucket))
    bucket, owner, values = bucket[order], owner[order], [v[order] for v in values]
    cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])) if len(order) else np.zeros(0, int)
    mine = heads[owner[cut]].copy()
    mine["count"] = np.diff(np.append(cut, len(order)))
    edges = np.searchsorted(bucket, np.unique(bucket))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
        lo, hi = np.searchsorted(cut, (a, b))
        yield int(bucket[a]), mine[lo:hi].tobytes(), *(v[a:b].tobytes() for v in values)


def _sketches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteWords(SPACED)
        for batch in slices(batches, "text"):
            heads, keys, seen = [], [], set()
            for s in shingle_sets(batch, words):
                name = _class(s)
                if name in seen:
                    continue
                seen.add(name)
                for band, found in sketch(s):
                    heads.append((name, len(s), len(found), 0, band))
                    keys.append(found)
            if not keys:
                continue
            heads = np.array(heads, _HEAD)
            owner = np.repeat(np.arange(len(heads)), heads["p"])
            keys = np.concatenate(keys)
            rows = list(zip(*_packed((keys % np.uint64(buckets)).astype(np.int32), owner, heads, keys)))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1]), pa.array(rows[2])], names=["bucket", "heads", "keys"])

    return run


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _repeated(buckets: int):
    """Of a bucket of keys, those of two classes or more, dealt back by class."""

    def run(table: pa.Table) -> pa.Table:
        heads, keys = _joined(table, "heads", _HEAD), _joined(table, "keys", "<u8")
        owner = np.repeat(np.arange(len(heads), dtype=np.int32), heads["count"])
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, owner = keys[keep], owner[keep]
        # A class met in several tasks counts once.
        name = heads["c"][owner]
        order = np.lexsort((name, keys))
        keys, owner, name = keys[order], owner[order], name[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (name[1:] != name[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, owner = keys[fresh], owner[fresh]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        size = np.diff(np.append(first, len(keys)))
        df = np.repeat(size, size)
        keep = df > 1
        keys, owner, df = keys[keep], owner[keep], df[keep].astype("<u4")
        rows = list(_packed((heads["c"][owner] % buckets).astype(np.int32), owner, heads, keys, df))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            names=["bucket", "heads", "keys", "dfs"],
        )

    return run


def _prefixes(table: pa.Table) -> pa.Table:
    """The keys by which each class is joined: its rarest n/3 + 1, keys of its own included."""
    heads, keys, df = _joined(table, "heads", _HEAD), _joined(table, "keys", "<u8"), _joined(table, "dfs", "<u4")
    name, band = np.repeat(heads["c"], heads["count"]), np.repeat(heads["band"], heads["count"])
    n, p = np.repeat(heads["n"], heads["count"]).astype(np.int64), np.repeat(heads["p"], heads["count"]).astype(np.int64)
    order = np.lexsort((keys, df, band, name))
    name, band, n, p, keys, df = (x[order] for x in (name, band, n, p, keys, df))
    if len(keys):
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (band[1:] != band[:-1])]))
        size = np.diff(np.append(first, len(keys)))
        rank = np.arange(len(keys)) - np.repeat(first, size)
        alone = p - np.repeat(size, size)
        # How many classes a cell of the set is in: high in the midst of a group of copies.
        middle = np.repeat(np.add.reduceat(df.astype(np.float64), first), size) / p
        keep = rank < np.minimum(p, n // 3 + 1) - alone
        name, n, keys, df, middle = name[keep], n[keep], keys[keep], df[keep], middle[keep]
    else:
        middle = np.zeros(0)
    return pa.table([keys.view(np.int64), name, n, df.astype(np.int64), middle], names=["key", "c", "n", "df", "middle"])


def _folded(bits: list[np.ndarray]) -> np.ndarray:
    """Sketches folded to the size of the smallest."""
    size = min(map(len, bits))
    out = np.zeros((len(bits), size), np.uint64)
    for k, x in enumerate(bits):
        out[k] = np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    return out


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of classes of two components with a common key, by size and by parity sketch.

    The key's classes outside its largest component (role 1) meet all its classes (role 0).
    """
    columns = ("key", "block", "other_block", "role", "c", "n", "component", "minor")
    key, block, other, role, c, n, component, minor = (table.column(x).to_numpy() for x in columns)
    bits = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("bits").combine_chunks()]
    order = np.lexsort((role, other, block, key))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(block[order]) != 0) | (np.diff(other[order]) != 0)]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
        rows = order[lo:hi]
        cut = int(np.searchsorted(role[rows], 1))
        every, few = rows[:cut], rows[cut:]
        if not len(every) or not len(few):
            continue
        short = _folded([bits[k] for k in rows])
        most = max(1, (1 << 21) // (cut * short.shape[1]))
        for at in range(0, len(few), most):
            mine = few[at : at + most]
            fits = (component[mine][:, None] != component[every]) & (~minor[every] | (c[mine][:, None] < c[every]))
            fits &= 3 * np.maximum(n[mine][:, None], n[every]) <= 4 * np.minimum(n[mine][:, None], n[every])
            apart = np.bitwise_count(short[cut + at : cut + at + len(mine), None] ^ short[:cut]).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(fits & (apart <= (n[mine][:, None] + n[every]) // 7))
            left.append(c[mine[x]])
            right.append(c[every[y]])
    left, right = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0)
    return pa.table([pairs[:, 0], pairs[:, 1]], names=["a", "b"])


def parity_bits(shingles: np.ndarray) -> bytes:
    """One bit a cell: whether an odd number of elements fell into it.

    Four times as many bits as elements, rounded up to a power of two of at least 64; a sketch
    folds to fewer bits by XOR of its halves.
    """
    size = 64
    while size < 4 * len(shingles):
        size *= 2
    place = (shingles & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _distance(x: np.ndarray, y: np.ndarray) -> int:
    """Unequal bits of two sketches, the larger folded to the smaller."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in no more bits than linked sets may have elements apart."""
    for batch in batches:
        left, right = ([np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(c)] for c in ("left", "right"))
        most = (batch.column("n").to_numpy() + batch.column("m").to_numpy()) // 7
        good = [_distance(x, y) <= d for x, y, d in zip(left, right, most.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = ByteWords(SPACED)
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch, words)
        columns = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        columns += [pa.array([f(s) for s in sets], pa.binary()) for f in (parity_bits, np.ndarray.tobytes)]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "bits", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("left"), batch.column("right")):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if len(x) > len(y):
                x, y = y, x
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            good.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Size, sketch and set of the classes (c) asked for."""
    wanted = cut_lineage(wanted)
    sets = docs.mapInArrow(_sets, "c long, n long, bits binary, shingles binary")
    sets = sets.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, "c", "left_semi")
    return cut_lineage(sets.groupBy("c").agg(F.first(F.struct("n", "bits", "shingles")).alias("s")).select("c", "s.*"))


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    left = sets.select(F.col("c").alias("a"), "n", F.col(column).alias("left"))
    right = sets.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a set has the
    distinct runs of five words, or the whole sequence where there are fewer. Rows link when
    their sets' Jaccard similarity is 0.75 or more; ``component_id`` is the smallest doc_id a
    row is linked to over any number of links, its own included. NULL, empty and blank texts
    have empty sets and link with nothing. Repeated rows link with each other, rows that
    share a doc_id stay rows, and a NULL doc_id is only a component's name if the component
    has no other. Further columns are not read; no rows give none.
    """
    rows, named = _grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    made = rows.join(named.select("c", "component_id"), "c", "left")
    one = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return made.select("doc_id", F.col("n").alias("n_shingles"), one.alias("component_id"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c, n) of every row, and of every class with words its smallest doc_id (first),
    its component and the smallest doc_id of that (component_id)."""
    rows = cut_lineage(docs.mapInArrow(_stats, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, c long, n long"))
    classes = cut_lineage(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = int(total * 0.75 / BUCKET_KEYS) + 1

    packed = docs.select("text").mapInArrow(_sketches(buckets), "bucket int, heads binary, keys binary")
    back = packed.groupBy("bucket").applyInArrow(_repeated(buckets), "bucket int, heads binary, keys binary, dfs binary")
    keyed = cut_lineage(back.groupBy("bucket").applyInArrow(_prefixes, "key long, c long, n long, df long, middle double"))

    # First each class meets a few hubs of the commonest of its keys: the one that shares most
    # of its set, which in a group of copies is the likeliest to be near them all, and two
    # others. That puts most of a group together with as many candidates as it has classes.
    common = keyed.groupBy("c").agg(F.max_by(F.struct("key", "n"), F.struct("df", "key")).alias("top")).select("c", "top.*")
    at = keyed.join(common.select("key").distinct(), "key", "left_semi")
    ranks = [F.struct(-F.col("middle"), F.col("c")), *[F.struct(F.xxhash64("c", F.lit(i)), F.col("c")) for i in range(2)]]
    hubs = at.groupBy("key").agg(*[F.min_by(F.struct("c", "n"), r).alias(f"h{i}") for i, r in enumerate(ranks)])
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(len(ranks))]))).alias("hub"))
    met = common.join(hubs, "key").where(_sizes("n", "hub.n")).select("c", F.col("hub.c").alias("d"))
    pairs = cut_lineage(_ordered(met))
    sets = _whole(docs, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    near = cut_lineage(_both(pairs, sets, "bits").mapInArrow(_near, "a long, b long"))
    links = cut_lineage(_both(near, sets, "shingles").mapInArrow(_verify, "a long, b long"))

    # Then classes with a common key that are still apart meet each other, in pieces of bounded
    # size that only hand on what the sketches leave.
    groups = components(links).withColumnRenamed("node", "c")
    keyed = keyed.join(groups, "c", "left").select("key", "c", "n", F.coalesce("component", "c").alias("component"))
    parties = keyed.groupBy("key", "component").agg(F.count("*").alias("size"))
    parties = parties.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.max("size").alias("most"))
    parties = parties.where(F.col("all") > F.col("most"))
    keyed = cut_lineage(keyed.join(parties, "key").withColumn("minor", F.col("component") != F.col("top")))
    sets = _whole(docs, keyed.select("c").distinct())
    blocks, others = F.ceil(F.col("all") / PIECE), F.ceil((F.col("all") - F.col("most")) / PIECE)
    shared = ["key", "c", "n", "component", "minor"]
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("c"), n)
    every = keyed.select(*shared, F.lit(0).alias("role"), own(blocks).alias("block"), spread(others).alias("other_block"))
    few = keyed.where("minor").select(*shared, F.lit(1).alias("role"), own(others).alias("other_block"), spread(blocks).alias("block"))
    parts = int(keyed.count() / (4 * PIECE)) + 1
    met = every.unionByName(few).withColumn("part", F.pmod(F.xxhash64("key", "block", "other_block"), F.lit(parts)))
    met = met.join(sets.select("c", "bits"), "c").groupBy("part").applyInArrow(_meet, "a long, b long")
    near = cut_lineage(met.distinct())
    links = links.union(cut_lineage(_both(near, sets, "shingles").mapInArrow(_verify, "a long, b long")))
    found = components(links)
    named = classes.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, named.join(least, "component").select("c", "first", "component", "component_id")


def _sizes(n: str, m: str):
    return (3 * F.greatest(n, m) <= 4 * F.least(n, m))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of every row with words, and the row; NULL for rows without words."""
    words = ByteWords(SPACED)
    for batch in slices(batches, "text"):
        names = [_class(s) if len(s) else None for s in shingle_sets(batch, words)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.to_struct_array()], names=["c", "row"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of linked rows; the same columns.

    That is the row smallest in doc_id (NULL last), then in text (NULL last), then in the other
    columns that can be ordered. Rows belong to a group by their text, so those with a NULL
    doc_id and those whose doc_id also stands in another group go or stay like any other. Rows
    without words stay.
    """
    rows, named = _grouped(docs.select("doc_id", "text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # A doc_id that one row has names that row: it stays where it is its group's smallest.
    single = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("uses")).where("uses = 1")
    groups = cut_lineage(named.select("component", "component_id").distinct().join(single, F.col("component_id") == F.col("doc_id"), "left"))
    kept = docs.where(worded).join(groups.where("uses = 1").select("doc_id"), "doc_id", "left_semi")

    # Of the other groups the rows with their smallest doc_id are compared.
    rest = groups.where("uses IS NULL").select("component")
    if rest.take(1):
        rest = named.join(rest, "component", "left_semi").where("first <=> component_id").select("c", "component", "component_id")
        ids = rest.select(F.col("component_id").alias("doc_id")).distinct()
        some = docs.where(worded).join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        kept = kept.select(docs.columns).union(_least_rows(some, rest))
    return kept.select(docs.columns).union(docs.where(~worded))


def _least_rows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each component of ``classes`` (c, component) the least row of ``docs``."""
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("row", docs.schema)])
    classed = docs.mapInArrow(_classed, schema)
    plain = [f.name for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    names = ["doc_id", "text", *(c for c in plain if c not in ("doc_id", "text"))]
    order = F.struct(*(x for c in names for x in (F.col("row")[c].isNull(), F.col("row")[c].alias(c))))
    if len(plain) == len(docs.columns):
        # The order has all of the row.
        least, back = F.min(order).alias("least"), [F.col("least")[c].alias(c) for c in docs.columns]
    else:
        least, back = F.min_by("row", order).alias("least"), ["least.*"]
    one = classed.groupBy("c").agg(least).join(classes, "c")
    order = F.col("least") if len(plain) == len(docs.columns) else F.struct(*(x for c in names for x in (F.col("least")[c].isNull(), F.col("least")[c])))
    return one.groupBy("component").agg(F.min_by("least", order).alias("least")).select(*back)
