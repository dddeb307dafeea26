"""Benchmark passages in training text, found with suffix arrays of the training side.

Each Arrow batch of documents is a shard. A shard's suffix array orders the word positions at
which a benchmark suffix could begin (its first words occur in the benchmark) by the words that
follow. Every benchmark suffix is looked up in it by binary search, which yields all places with
the same next ``window`` words; matches on one diagonal are joined to the longest verbatim ones.
Documents never leave their shard: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.llm.bytewords import PLAIN, ByteWords, mix, slices, text_buffer
from vitalspan.session import cut_lineage

WINDOW = 10
SHARD_BYTES = 8 << 20
#: Benchmark text indexed at a time; a larger benchmark takes several passes.
ITEM_BYTES = 16 << 20
_SALT = np.uint64(0x8F1BBCDCBFA53E0B)

MATCHES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "longest",
            T.StructType(
                [
                    T.StructField("item_id", T.StringType()),
                    T.StructField("doc_word", T.LongType()),
                    T.StructField("item_word", T.LongType()),
                    T.StructField("n_words", T.LongType()),
                ]
            ),
        ),
    ]
)


def _keys(hashes: np.ndarray, at: np.ndarray, stop: np.ndarray, depth: int, fill: int) -> np.ndarray:
    """The next ``depth`` word hashes of each position as one byte string that sorts by words."""
    out = np.full((len(at), depth), np.uint64(fill), ">u8")
    padded = np.concatenate([hashes, np.zeros(depth, np.uint64)])
    for k in range(depth):
        inside = at + k < stop
        out[inside, k] = padded[at[inside] + k]
    return out.view(f"V{8 * depth}").ravel()


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _SALT + hashes[1:])


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Suffixes:
    """The windows of one block of benchmark items, ready to be looked up."""

    def __init__(self, rows: Sequence[tuple[str, str]], window: int):
        self.window = window
        self.ids = np.array([r[0] for r in rows], object)
        self.rank = np.unique(self.ids, return_inverse=True)[1]
        data, offsets = text_buffer(pa.array([r[1] for r in rows], pa.string()))
        hashes, _, _, bounds = ByteWords(PLAIN).of(data, offsets)
        sizes = np.diff(bounds)
        counts = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
        self.item = np.repeat(np.arange(len(rows)), counts)
        self.word = np.arange(len(self.item)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = bounds[self.item] + self.word
        self.length = np.minimum(sizes[self.item], window)
        self.low = _keys(hashes, at, at + self.length, window, 0)
        self.high = _keys(hashes, at, at + self.length, window, (1 << 64) - 1)
        self.singles = np.unique(hashes[at[self.length == 1]])
        long = at[self.length > 1]
        self.pairs = np.unique(_pairs(hashes)[long]) if len(long) else np.zeros(0, np.uint64)

    def match(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence in the shard, by suffix array."""
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.item):
            return none, none
        start = np.zeros(len(hashes), bool)
        if len(self.pairs):
            start[:-1] = _within(_pairs(hashes), self.pairs)
        if len(self.singles):
            start |= _within(hashes, self.singles)
        at = np.flatnonzero(start)
        if not len(at):
            return none, none
        stop = bounds[np.searchsorted(bounds, at, "right")]
        keys = _keys(hashes, at, stop, self.window, 0)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        first = np.searchsorted(keys, self.low, "left")
        count = np.searchsorted(keys, self.high, "right") - first
        window = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + first[window]
        return window, at[place]


def _longest(item: np.ndarray, word: np.ndarray, at: np.ndarray, length: np.ndarray):
    """Runs of matches on one diagonal of one item: (item, item word, position, words)."""
    order = np.lexsort((word, at - word, item))
    item, word, at, length = item[order], word[order], at[order], length[order]
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(at - word) != 0) | (np.diff(word) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    return item[first], word[first], at[first], word[last] - word[first] + length[last]


def _annotate(batch: pa.RecordBatch, known: Suffixes, words: ByteWords, text: str, earlier: list | None) -> list[dict]:
    data, offsets = text_buffer(batch.column(text))
    hashes, _, _, bounds = words.of(data, offsets)
    window, at = known.match(hashes, bounds)
    length = known.length[window]
    delta = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + length, -1)
    hit = np.cumsum(delta[:-1]) > 0 if len(hashes) else np.zeros(0, bool)
    n = batch.num_rows
    # Runs of hit words, cut where a new document begins.
    edge = hit.copy()
    edge[1:] &= ~hit[:-1]
    inner = bounds[:-1][bounds[:-1] < len(hashes)]
    edge[inner] = hit[inner]
    starts = np.flatnonzero(edge)
    stop = hit.copy()
    stop[:-1] &= ~hit[1:]
    ends = bounds[1:][bounds[1:] > 0] - 1
    stop[ends] = hit[ends]
    stops = np.flatnonzero(stop) + 1
    of_doc = np.searchsorted(bounds, starts, "right") - 1
    spans: list[list] = [[] for _ in range(n)]
    for d, a, b in zip(of_doc.tolist(), starts.tolist(), stops.tolist()):
        base = int(bounds[d])
        spans[d].append((a - base, b - base))
    items: list[set] = [set() for _ in range(n)]
    best: list[tuple | None] = [None] * n
    if len(at):
        run_item, run_word, run_at, run_n = _longest(known.item[window], known.word[window], at, length)
        doc = np.searchsorted(bounds, run_at, "right") - 1
        for d, i in set(zip(doc.tolist(), run_item.tolist())):
            items[d].add(known.ids[i])
        order = np.lexsort((run_word, known.rank[run_item], run_at, -run_n, doc))
        lead = np.ones(len(order), bool)
        lead[1:] = np.diff(doc[order]) != 0
        for k in order[lead].tolist():
            d = int(doc[k])
            best[d] = (known.ids[run_item[k]], int(run_at[k] - bounds[d]), int(run_word[k]), int(run_n[k]))
    out = []
    counts = np.diff(bounds).tolist()
    for d in range(n):
        hits, names, top = spans[d], items[d], best[d]
        if earlier is not None:
            hits = _joined(hits + [(h["start"], h["stop"]) for h in earlier[d]["hits"]])
            names = names | set(earlier[d]["items"])
            old = earlier[d]["longest"]
            found = [m for m in (top, old and (old["item_id"], old["doc_word"], old["item_word"], old["n_words"])) if m]
            top = min(found, key=lambda m: (-m[3], m[1], m[0], m[2]), default=None)
        out.append(
            {
                "n_words": counts[d],
                "hits": [{"start": a, "stop": b} for a, b in hits],
                "items": sorted(names),
                "longest": top and dict(zip(("item_id", "doc_word", "item_word", "n_words"), top)),
            }
        )
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match_items(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str] | None = None,
    into: str = "matches",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) and a struct ``into`` with all matches.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A match is a
    run of ``window`` item words, or a whole shorter item. ``hits`` has the disjoint runs of
    matched document words, ``items`` the matched ids as sorted distinct strings, ``longest``
    the longest verbatim match and its places (ties: the first in the document, then the
    smallest item id, then the first in the item). NULL and empty texts have no words; items without words match nothing; a NULL
    item_id counts as the empty string; no items give no matches. A column of ``docs`` named
    like ``into`` is replaced. About ``item_bytes`` of the benchmark are held at a time: a
    larger one is split by hash into blocks of that size, each a pass over the documents whose
    result is stored before the next block is fetched.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // item_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    done = docs
    for b in range(blocks):
        rows = [(r["id"], r["text"]) for r in items.where(block == b).select("id", "text").sort("id", "text").toLocalIterator()]
        last = b == blocks - 1
        columns = [*keep, *([] if last or text in keep else [text])]
        source = [*columns, *([into] if b else []), *([text] if text not in columns else [])]
        schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(into, MATCHES)])
        done = done.select(*dict.fromkeys(source)).mapInArrow(_pass(rows, columns, text, into, window, bool(b)), schema)
        if not last:
            done = cut_lineage(done)
    return done


def _pass(rows: list, columns: list[str], text: str, into: str, window: int, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = Suffixes(rows, window), ByteWords(PLAIN)
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ("items", pa.list_(pa.string())),
                ("longest", pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])),
            ]
        )
        for batch in slices(batches, text, SHARD_BYTES):
            earlier = batch.column(into).to_pylist() if again else None
            found = pa.array(_annotate(batch, known, words, text, earlier), kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), found], names=[*columns, into])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; the same columns."""
    name = "matches"
    while name in docs.columns:
        name += "_"
    found = match_items(docs, items, into=name, **options)
    return found.where(F.size(F.col(name)["hits"]) == 0).select(*docs.columns)
