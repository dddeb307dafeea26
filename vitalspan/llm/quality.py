"""Document quality by random-indexing word vectors and a two-layer network.

Random indexing: every token has a fixed sparse ternary index vector read off its hash, and a
token's word vector is the sum of the index vectors of the tokens beside it, all over the
corpus. Tokens share ``BUCKETS`` rows, so the table has one size whatever the corpus, and
tasks add up their own before anything is shuffled. A document is the mean of its words'
vectors and of its word shapes' vectors; NumPy fits the network on a bounded labelled sample,
then one temperature on rows of it that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import ByteWords, mix, slices, table_of, text_buffer

BUCKETS = 8_192
WIDTH = 32
#: Index vectors have this many entries that are not zero.
MARKS = 2
#: Labelled rows the network is fitted on at most.
SAMPLE_ROWS = 8_000
HIDDEN = 24

_KIND = np.array([0 if b <= 0x20 else 1 if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 2 for b in range(256)], np.uint8)
_UPPER = table_of(lambda b: 0x41 <= b <= 0x5A)
_DIGIT = table_of(lambda b: 0x30 <= b <= 0x39)


def training_rows(labels: DataFrame, label: str, folds: int, held: int, at_most: int) -> DataFrame:
    """(doc_id, y): a bounded sample of the rows that may be learnt from, the same each time.

    Rows with crc32(doc_id as text) mod ``folds`` equal to ``held``, and those without doc_id
    or label, are left out; a doc_id labelled twice counts as its larger label.
    """
    free = F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held)
    rows = labels.where(free).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)


def is_held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


class Tokens:
    """Words and runs of marks of a batch, and the shape of each."""

    def __init__(self):
        self.words = ByteWords(_KIND > 0, fold=False)

    def of(self, batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, shape hashes and the first token of every text."""
        data, offsets = text_buffer(batch.column(text))
        part = _KIND[data[offsets[0] : offsets[-1]]]
        cuts = np.flatnonzero((part[1:] != part[:-1]) & (part[1:] > 0) & (part[:-1] > 0)) + offsets[0] + 1
        hashes, start, end, bounds = self.words.of(data, offsets, cuts)
        if not len(start):
            return hashes, hashes, bounds
        first, last = data[start], data[end - 1]
        shape = _KIND[first].astype(np.uint64) + np.uint64(4) * _UPPER[first] + np.uint64(8) * _UPPER[last] + np.uint64(16) * _DIGIT[first]
        shape += np.uint64(32) * np.minimum(end - start, 12).astype(np.uint64)
        # Marks keep their kind: they are few.
        shape = np.where(_KIND[first] == 2, shape + np.uint64(1 << 20) * (first.astype(np.uint64) + np.uint64(1)), shape)
        return hashes, mix(shape + np.uint64(0x5851F42D4C957F2D)), bounds


def _rows(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(BUCKETS)).astype(np.int64)


def _marks(tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for k in range(MARKS):
        h = tokens >> np.uint64(16 + 12 * k)
        out.append(((h % np.uint64(WIDTH)).astype(np.int64), 1 - 2 * ((h >> np.uint64(8)) & np.uint64(1)).astype(np.int64)))
    return out


def add_contexts(total: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> None:
    """Add to each token's row the index vectors of the tokens right beside it."""
    if len(tokens) < 2:
        return
    inside = np.ones(len(tokens) - 1, bool)
    cut = bounds[1:-1]
    inside[cut[(cut > 0) & (cut < len(tokens))] - 1] = False
    rows, marks = _rows(tokens), _marks(tokens)
    for at, sign in marks:
        for own, other in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
            place = rows[own][inside] * WIDTH + at[other][inside]
            total += np.bincount(place, sign[other][inside], len(total)).astype(np.int64)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = Tokens(), np.zeros(BUCKETS * WIDTH, np.int64)
    for batch in slices(batches, "text"):
        hashes, shapes, bounds = tokens.of(batch)
        add_contexts(total, hashes, bounds)
        add_contexts(total, shapes, bounds)
    table = total.reshape(BUCKETS, WIDTH)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, k]) for k in range(WIDTH))], names=["row", *(f"x{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of unit word vectors of the whole corpus: ``BUCKETS`` x ``WIDTH``."""
    columns = [f"x{k}" for k in range(WIDTH)]
    parts = docs.select("text").mapInArrow(_tables, "row long, " + ", ".join(f"{c} long" for c in columns))
    # One row for a bucket: a table of fixed size, whatever the corpus.
    found = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    table = np.zeros((BUCKETS, WIDTH))
    if found.num_rows:
        table[found.column("row").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], 1)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(batch: pa.RecordBatch, tokens: Tokens, table: np.ndarray) -> np.ndarray:
    """Mean vectors of each text's words and shapes, and a constant for texts with tokens."""
    hashes, shapes, bounds = tokens.of(batch)
    out = np.zeros((batch.num_rows, 2 * WIDTH + 1), np.float32)
    size = np.diff(bounds)
    some = size > 0
    if some.any():
        for k, seen in enumerate((hashes, shapes)):
            # A tally of buckets by text, then one product: no token has a vector of its own.
            text = np.repeat(np.arange(len(size)), size)
            pairs, times = np.unique(text * BUCKETS + _rows(seen), return_counts=True)
            sums = np.zeros((len(size), WIDTH))
            scaled = table[pairs % BUCKETS] * times[:, None]
            first = np.searchsorted(pairs // BUCKETS, np.flatnonzero(some))
            sums[some] = np.add.reduceat(scaled, first, axis=0)
            out[some, k * WIDTH : (k + 1) * WIDTH] = sums[some] / size[some, None]
        out[some, -1] = 1.0
    return out


class Network:
    """Inputs scaled to unit deviation, one layer of tanh units, one output; a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, rounds: int = 60):
        self.mean, self.scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
        self.hot, self.base = 1.0, 0.0
        self.fitted = len(y) >= 20 and 0 < y.mean() < 1
        if not self.fitted:
            self.base = float(np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0)))
            return
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        out = np.arange(len(y)) % 5 == 0  # left out for the temperature
        fit_x, fit_y = x[~out], y[~out].astype(float)
        self.w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        moment, power, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(rounds):
            order = draw.permutation(len(fit_y))
            for a in range(0, len(order), 64):
                bx, by = fit_x[order[a : a + 64]], fit_y[order[a : a + 64]]
                hidden = np.tanh(bx @ self.w[0] + self.w[1])
                off = (1 / (1 + np.exp(-(hidden @ self.w[2] + self.w[3]))) - by) / len(by)
                back = off[:, None] * self.w[2] * (1 - hidden**2)
                grads = [bx.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ off + 1e-4 * self.w[2], off.sum(keepdims=True)]
                t += 1
                for w, g, m, p in zip(self.w, grads, moment, power):  # Adam
                    m += 0.1 * (g - m)
                    p += 0.001 * (g * g - p)
                    w -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(p / (1 - 0.999**t)) + 1e-8)
        logit, truth = self._logit(x[out]), y[out]
        if 0 < truth.mean() < 1:
            grid = np.geomspace(0.25, 8, 60)
            loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / h).mean() for h in grid]
            self.hot = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.hot, -40, 40)))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    ``score`` is the calibrated probability of label 1, from the text alone; ``predicted`` is
    1 from 0.5 on. NULL, empty and blank texts have the all-zero document vector and get its
    score. Without labels of both kinds every score is the base rate. Repeated rows score
    alike; a NULL doc_id is not held out; further columns are not read; no rows give none.
    """
    docs = docs.select("doc_id", "text")
    table = word_vectors(docs)
    sample = training_rows(labels, label, folds, held, sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in slices(batches, "text"):
            x = pooled(batch, tokens, table)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ``sample_rows`` labels, and as many rows: a doc_id may stand in any number of them.
    fit = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(features, f"doc_id {kind}, y int, x array<float>")
    fit = fit.dropDuplicates().orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(sample_rows).toArrow()
    x = np.array(fit.column("x").to_pylist(), float).reshape(fit.num_rows, 2 * WIDTH + 1)
    y = fit.column("y").to_numpy().astype(int)
    order = np.lexsort((*x.T[:4], y))
    order = order[np.random.default_rng(1).permutation(len(order))]
    network = Network(x[order], y[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in slices(batches, "text"):
            score = network.score(pooled(batch, tokens, table).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
