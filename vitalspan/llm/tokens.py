"""Token ids of documents in Simple-8b files, written in order and read back in parallel.

The file format is Parquet with one row per segment, a run of whole documents in order:
``part`` and ``first`` (the ids ahead of it in its part), ``n_ids``, ``doc_ids``, ``n_tokens``
(by document, the end id included), ``blocks`` (first word of every block of 1024 ids) and
``words`` (little-endian 64-bit Simple-8b words).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.llm import simple8b
from vitalspan.llm.bytewords import SPACED, ByteWords, slices, table_of, text_buffer

SEGMENT_IDS = 1 << 20
#: Entries of a worker's table of encoded words; a full table starts anew.
CACHE_WORDS = 1_500_000
_TOGETHER = 2_000
_SPACED_SALT = np.uint64(0x5851F42D4C957F2D)
_LETTER = table_of(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_MARK = table_of(lambda b: chr(b) in ".,;:!?")


class Encoder:
    """Ids of texts by a byte-level BPE file, each distinct word going through the library once.

    The file's pre-tokenizer cuts in front of a single space, around a single line break and
    between a letter and a mark, so a text is put together from the ids of the units between
    such places: found, hashed to 64 bits, looked up and laid out for a whole batch at a time.
    A text with any other white space goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words = ByteWords(SPACED, fold=False)
        (self.newline,) = self._whole("\n").tolist()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many each has.

        A unit of plain letters is one piece, which the file's model takes as it is. For the
        others, line breaks, which no unit holds, keep units apart in one text for many.
        """
        tokenize = self.model.model.tokenize
        found = {i: [t.id for t in tokenize(u.replace(" ", "\u0120"))] for i, u in enumerate(units) if u.isascii() and u.lstrip(" ").isalpha()}
        rest = [i for i in range(len(units)) if i not in found]
        if rest:
            ids, sizes = self._apart([units[i] for i in rest])
            found.update(zip(rest, (x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1]))))
        parts = [found[i] for i in range(len(units))]
        return np.array([x for p in parts for x in p], np.uint32), np.array([len(p) for p in parts])

    def _apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = ["\n" + "\n".join(units[i : i + _TOGETHER]) for i in range(0, len(units), _TOGETHER)]
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        heads = np.flatnonzero(ids == self.newline)
        return np.delete(ids, heads), np.diff(np.append(heads, len(ids))) - 1

    def batch(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` behind each, and how many every text has."""
        data, offsets = text_buffer(column)
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        part = data[offsets[0] : offsets[-1]]
        cuts = np.flatnonzero(_LETTER[part[:-1]] & _MARK[part[1:]]) + offsets[0] + 1
        hashes, start, end, bounds = self.words.of(data, offsets, cuts)
        text = np.repeat(np.arange(len(column)), np.diff(bounds))
        head = start == offsets[text]
        before = np.where(head, 0, data[start - 1]) if len(start) else np.zeros(0, np.uint8)
        spaced, broken = before == 0x20, before == 0x0A
        odd = np.zeros(len(column), bool)
        # White space must stand alone, between units.
        glued = ~head & SPACED[before] & (before != 0)
        lone = spaced | broken
        ahead = np.concatenate([[-1], end[:-1]]) if len(end) else end
        good = head | glued | (lone & (ahead == start - 1))
        odd[text[~good]] = True
        size = np.diff(offsets)
        some = np.diff(bounds) > 0
        odd[(size > 0) & ~some] = True
        last = bounds[1:][some] - 1
        odd[np.flatnonzero(some)[end[last] != offsets[1:][some]]] = True

        keys = np.where(spaced, hashes ^ _SPACED_SALT, hashes)
        distinct, sample, place = np.unique(keys, return_index=True, return_inverse=True)
        there = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(there, len(self.keys) - 1)] != distinct
        if new.any():
            raw = data.data
            rows = sample[new]
            units, bad = [], []
            for a, b, s in zip(start[rows].tolist(), end[rows].tolist(), spaced[rows].tolist()):
                unit = str(raw[a:b], "utf-8")
                bad.append(unit[0].isspace() or unit[-1].isspace())
                units.append("x" if bad[-1] else " " + unit if s else unit)
            ids, sizes = self._learn(units)
            at = len(self.known) + np.cumsum(sizes) - sizes
            sizes = np.where(bad, -1, sizes)
            self.keys = np.insert(self.keys, there[new], distinct[new])
            self.at = np.insert(self.at, there[new], at)
            self.size = np.insert(self.size, there[new], sizes)
            self.known = np.concatenate([self.known, ids])
            there = np.searchsorted(self.keys, distinct)
        take, many = self.at[there][place], self.size[there][place].astype(np.int64)
        odd[text[many < 0]] = True
        many = np.maximum(many, 0)

        lengths = many + broken
        behind = np.cumsum(lengths)
        out = np.empty(int(behind[-1]) if len(behind) else 0, np.uint32)
        first = behind - lengths
        out[first[broken]] = self.newline
        first = first + broken
        held = np.repeat(take - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        spot = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out[spot] = self.known[held]
        ends = np.concatenate([[0], behind])[bounds]
        counts = np.diff(ends) + 1
        if not odd.any():
            return np.insert(out, ends[1:], end_id), counts
        parts = []
        for i in range(len(column)):
            parts.append(self._whole(column[i].as_py()) if odd[i] else out[ends[i] : ends[i + 1]])
            parts.append(np.array([end_id], np.uint32))
            counts[i] = len(parts[-2]) + 1
        return np.concatenate(parts), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file, so its table serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, order: Sequence = ("doc_id",)) -> None:
    """Write the ids of every whole text, ``end_id`` behind each, in ascending ``order``.

    One range shuffle puts documents in order; rows that tie go by doc_id and text, so repeated
    rows stay, side by side. NULL keys come first. NULL and empty texts are the end id alone.
    Other columns are not read; no documents make a file without rows.
    """
    kind = docs.schema["doc_id"].dataType
    source = docs.select(F.col("doc_id"), F.col("text"), *[F.col(c).alias(f"order_{i}") if isinstance(c, str) else c.alias(f"order_{i}") for i, c in enumerate(order)])
    keys = [f"order_{i}" for i in range(len(order))]
    placed = source.repartitionByRange(*keys, F.xxhash64("text")).sortWithinPartitions(*keys, "doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("n_tokens", T.ArrayType(T.LongType())),
            T.StructField("blocks", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, model = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        owners: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            nonlocal first
            ids = np.concatenate(held)
            words, blocks = simple8b.encode(ids)
            names = pa.concat_arrays(owners)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                    pa.array([blocks], pa.list_(pa.int32())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                ],
                names=schema.names,
            )
            first += len(ids)
            owners.clear()
            held.clear()
            sizes.clear()
            return row

        for batch in slices(batches, "text", 1 << 20):
            ids, counts = model.batch(batch.column("text"), end_id)
            held.append(ids)
            sizes.append(counts)
            owners.append(batch.column("doc_id"))
            if sum(map(len, held)) >= SEGMENT_IDS:
                yield segment()
        if held:
            yield segment()

    placed.select("doc_id", "text").mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of every document written.

    ``start`` counts the ids of all documents ahead. Segments decode in parallel; only a total
    for each part, as many rows as the file has parts, is summed up in one place.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                total = row.column("n_ids")[0].as_py()
                words = np.frombuffer(row.column("words")[0].as_py(), "<u8")
                ids = simple8b.decode(words, row.column("blocks").flatten().to_numpy(), total).astype("<u4")
                sizes = row.column("n_tokens").flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist())]
                columns = [
                    row.column("doc_ids").flatten(),
                    pa.array(np.full(len(sizes), row.column("part")[0].as_py(), np.int32)),
                    pa.array(starts + row.column("first")[0].as_py()),
                    pa.array(sizes),
                    pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    bounds = pa.array(np.append(starts, total).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = stored.mapInArrow(run, schema)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # One row for each part of the file: its size is that of the file's listing.
    joined = rows.join(F.broadcast(totals), "part")
    return joined.select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
