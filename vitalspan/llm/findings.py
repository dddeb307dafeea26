"""Findings, all of them or a bounded sample, taken in the scan so that no whole text leaves its task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import slices

Finding = tuple[int, bytes]  # stratum, what is learned from


class Smallest:
    """The ``n`` distinct items of each stratum with the smallest digests."""

    def __init__(self, n: int):
        self.n, self.kept, self.bound = n, {}, {}

    def add(self, stratum: int, item: bytes) -> None:
        key = hashlib.blake2b(item, digest_size=16).digest()
        if stratum in self.bound and key > self.bound[stratum]:
            return
        mine = self.kept.setdefault(stratum, {})
        mine[key] = item
        if len(mine) >= 4 * max(1, self.n):
            self._cut(stratum)

    def _cut(self, stratum: int) -> None:
        first = sorted(self.kept[stratum].items())[: self.n]
        self.kept[stratum] = dict(first)
        if first:
            self.bound[stratum] = first[-1][0]

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        for stratum in sorted(self.kept):
            self._cut(stratum)
            yield from ((stratum, key, item) for key, item in self.kept[stratum].items())


def sampled_findings(docs: DataFrame, find: Callable[[str], Iterable[Finding]], n: int) -> list[Finding]:
    """The ``n`` distinct findings of each stratum with the smallest digests, over all of ``docs``.

    Every task reads whole texts and hands on ``n`` findings a stratum at most, so the sample
    does not depend on how the texts are dealt to tasks, and copies of a text count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = Smallest(n)
        for batch in slices(batches, "text"):
            for text in batch.column("text").fill_null("").to_pylist():
                for stratum, item in find(text):
                    smallest.add(stratum, item)
        rows = list(smallest.rows())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["stratum", "key", "item"])

    found = docs.select("text").mapInArrow(run, "stratum int, key binary, item binary").dropDuplicates(["stratum", "key"])
    first = Window.partitionBy("stratum").orderBy("key")
    few = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)
    return [(r["stratum"], bytes(r["item"])) for r in few.orderBy("stratum", "key").collect()]


def every_finding(docs: DataFrame, find: Callable[[str], Iterable[Finding]]) -> DataFrame:
    """(stratum, item): the distinct findings of all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = {f for text in batch.column("text").fill_null("").to_pylist() for f in find(text)}
            columns = [pa.array([stratum for stratum, _ in found], pa.int32()), pa.array([item for _, item in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["stratum", "item"])

    return docs.select("text").mapInArrow(run, "stratum int, item binary").distinct()
