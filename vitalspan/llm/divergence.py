"""How far the sources of a language differ in the words they use.

Term frequencies come from an index built in one pass: a task collects the postings of its
documents in memory, and whenever a block of them is full it lets go of term-sorted runs, one
for each hash shard and source. The runs of a shard, whose text is bounded, are merged at once
into the order of terms and sources, which gives each posting the language's total.

A pair of sources is the sum of |p - q| over all kept terms. All but a part of it follows from
each source's histogram of p; the part is a correction for terms that both sources have, which
is added up while postings stream by in term order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import slices
from vitalspan.session import cut_lineage

#: A term is kept in a language from so many of its documents on.
MIN_DOCUMENTS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
#: Postings (term, source) a task holds before it lets go of runs.
BLOCK_POSTINGS = 300_000
#: Bytes of text for each shard of the index.
SHARD_BYTES = 24 << 20
#: Pairs of sources a task adds up before it hands them on.
HELD_PAIRS = 200_000
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Everything but a term's bytes becomes a blank, A-Z become a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b in _LETTERS else 32 for b in range(256))
_PIECE = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size."""
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        part = text[at:end].translate(_FOLD)
        if end < len(text):
            # On to the end of the term.
            more = re.compile(rb"[A-Za-z\x80-\xff]*").match(text, end).end()
            part, end = part + text[end:more].translate(_FOLD), more
        yield part.split()
        at = end


class Block:
    """Postings of some documents: how often and in how many of them a group has a term."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.documents: dict[tuple[str, str], Counter] = {}

    def add(self, group: tuple[str, str], text: bytes) -> None:
        counts, seen = self.counts.setdefault(group, Counter()), set()
        for found in terms(text):
            counts.update(found)
            seen.update(found)
        self.documents.setdefault(group, Counter()).update(seen)

    def __len__(self) -> int:
        return sum(map(len, self.counts.values()))

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        """Of each group and shard the terms in order, their counts and document counts."""
        for (lang, source), counts in self.counts.items():
            documents = self.documents[lang, source]
            dealt = sorted((crc32(t) % shards, t) for t in counts)
            rows = []
            for shard, part in groupby(dealt, itemgetter(0)):
                part = [t for _, t in part]
                numbers = np.array([[counts[t], documents[t]] for t in part], "<i8")
                rows.append((lang, shard, source, b"\n".join(part), numbers[:, 0].tobytes(), numbers[:, 1].tobytes()))
            for at in range(0, len(rows), 5_000):
                columns = list(zip(*rows[at : at + 5_000]))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "shard", "source", "terms", "counts", "documents"])


def _index(shards: int, block_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                block.add((lang, source), text)
            if len(block) >= block_postings:
                yield from block.runs(shards)
                block = Block()
        yield from block.runs(shards)

    return run


def _terms_of(runs: list[bytes]) -> pa.LargeBinaryArray:
    """The terms of all runs, one after another; a term has no line break."""
    raw = np.frombuffer(b"".join(x for run in runs for x in (run, b"\n")), np.uint8)
    breaks = np.flatnonzero(raw == 10)
    ends = np.concatenate([[0], breaks - np.arange(len(breaks))]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(breaks), [None, pa.py_buffer(ends), pa.py_buffer(raw[raw != 10])])


def _merged(least: int):
    """Of a shard's runs, the terms in ``least`` documents or more by source, with their total.

    All runs are merged at once: every term gets its place in the order of the shard's terms, and
    postings are brought into the order of these places and of sources.
    """

    def run(table: pa.Table) -> pa.Table:
        names = ["lang", "term", "source", "n", "total"]
        if not table.num_rows:
            return pa.table([pa.array([], pa.string())] * 3 + [pa.array([], pa.int64())] * 2, names=names)
        counts, documents = (table.column(c).to_pylist() for c in ("counts", "documents"))
        found, source = _terms_of(table.column("terms").to_pylist()).dictionary_encode(), table.column("source").combine_chunks().dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        term = place[found.indices.to_numpy()]
        size = len(source.dictionary)
        key = term * size + np.repeat(source.indices.to_numpy().astype(np.int64), [len(c) // 8 for c in counts])
        sorted_by = np.argsort(key, kind="stable")
        key = key[sorted_by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n, d = (np.add.reduceat(np.frombuffer(b"".join(x), "<i8")[sorted_by], first) for x in (counts, documents))
        term, source_of = np.divmod(key[first], size)
        opens = np.flatnonzero(np.diff(term, prepend=-1))
        held = np.diff(np.append(opens, len(term)))
        total, enough = (np.repeat(np.add.reduceat(x, opens), held) for x in (n, d))
        kept = enough >= least
        shown = found.dictionary.take(order.take(pa.array(term[kept]))).cast(pa.binary()).cast(pa.string())
        lang = pa.array([table.column("lang")[0].as_py()] * len(shown), pa.string())
        return pa.table([lang, shown, source.dictionary.take(pa.array(source_of[kept])), pa.array(n[kept]), pa.array(total[kept])], names=names)

    return run


def frequencies(docs: DataFrame, least: int = MIN_DOCUMENTS, block_postings: int = BLOCK_POSTINGS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, term, source, n, total) of every term in at least ``least`` documents of its
    language: its occurrences in each source that has it, and in all of them."""
    rows = docs.where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // shard_bytes + 1
    runs = rows.mapInArrow(_index(shards, block_postings), "lang string, shard int, source string, terms binary, counts binary, documents binary")
    made = runs.groupBy("lang", "shard").applyInArrow(_merged(least), "lang string, term string, source string, n long, total long")
    return cut_lineage(made)


def _corrections(held_pairs: int):
    """Of postings in (lang, term, source) order: for pairs of sources, over the terms both have,
    |p - q| less what the sources' histograms give for such a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def handed_on():
            keys = list(zip(*held)) if held else [[], [], []]
            columns = [pa.array(k, pa.string()) for k in keys]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], names=["lang", "a", "b", "correction"])
            held.clear()
            return out

        for table in _whole_terms(batches):
            lang, term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
            p, none = table.column("p").to_numpy(), table.column("none").to_numpy()
            names, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
            lang, term, source = (np.asarray(x.indices, np.int64) for x in (lang, term, source))
            at, step = np.arange(len(p) - 1), 1
            while len(at):
                # Postings ``step`` places apart that belong to one term.
                at = at[at + step < len(p)]
                other = at + step
                same = (term[at] == term[other]) & (lang[at] == lang[other])
                at, other = at[same], other[same]
                value = np.abs(p[at] - p[other]) - np.abs(p[at] - none[other]) - np.abs(p[other] - none[at]) + np.abs(none[at] - none[other])
                key = (lang[at] * len(names) + source[at]) * len(names) + source[other]
                keys, place = np.unique(key, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, value)
                for k, v in zip(keys.tolist(), sums.tolist()):
                    pair = (langs[k // len(names) ** 2], names[k // len(names) % len(names)], names[k % len(names)])
                    held[pair] = held.get(pair, 0) + v
                if len(held) >= held_pairs:
                    yield handed_on()
                step += 1
        yield handed_on()

    return run


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut between terms."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        last = tuple(table.column(c)[-1] for c in ("lang", "term"))
        cut = table.num_rows - 1
        while cut and tuple(table.column(c)[cut - 1] for c in ("lang", "term")) == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        left = table.slice(cut)
    if left is not None:
        yield left


def _p(n, total, vocabulary):
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * vocabulary)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(38,0)) * ({n} + {SMOOTH})) div ({total} + {SMOOTH} * {vocabulary})")


def audit(
    docs: DataFrame,
    least: int = MIN_DOCUMENTS,
    block_postings: int = BLOCK_POSTINGS,
    shard_bytes: int = SHARD_BYTES,
    held_pairs: int = HELD_PAIRS,
) -> DataFrame:
    """lang, source, part, item, value and rank: how each source's use of words differs.

    NULL text, lang and source are empty. Terms are runs of letters a-z, A-Z lower-cased, and
    characters beyond ASCII. A language's vocabulary are the V terms found in ``least`` of
    its documents or more, repeated rows counting each. p is 1 + floor(SCALE * (n + SMOOTH) /
    (N + SMOOTH * V)), n and N the term's and all terms' occurrences in the source, or in the
    language for q. Part ``pair`` has every other source of the language with the sum of
    |p - q| over the vocabulary, q the other's p; part ``term`` the TOP terms of the source by
    p - q, where that is above zero. Ranks go by value descending, then item in UTF-8 order. A
    source without terms, or a language without a vocabulary, has its pairs too. Further
    columns are not read; no rows give none. The other parameters bound what a task holds and
    do not change the result.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = frequencies(read, least, block_postings, shard_bytes)
    kept = found.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang")
    langs = kept.agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_total"))
    sources = found.groupBy("lang", "source").agg(F.sum("n").alias("source_total"), F.count("*").alias("present"))
    groups = read.select("lang", "source").distinct().join(sources, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["source_total", "present", "vocabulary", "lang_total"])
    # The p of a term that the source does not have.
    groups = cut_lineage(groups.withColumn("none", F.when(F.col("vocabulary") > 0, _p("0L", "source_total", "vocabulary"))))

    rows = found.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "none", _p("n", "source_total", "vocabulary").alias("p"), _p("total", "lang_total", "vocabulary").alias("q")
    )
    rows = cut_lineage(rows)

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    over = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)

    streamed = rows.select("lang", "term", "source", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = streamed.mapInArrow(_corrections(held_pairs), "lang string, a string, b string, correction long").groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))

    # The sum of |p - x| over a source's terms, x being the other's p for a term it lacks, from
    # running sums over the source's histogram, into which the values of x are laid.
    pairs = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("x"), F.col("present").alias("n_a"), "vocabulary").join(
        groups.select("lang", F.col("source").alias("b"), F.col("none").alias("y"), F.col("present").alias("n_b")), "lang"
    )
    pairs = pairs.where("a <> b")
    zero = F.lit(0).cast("long")
    histogram = rows.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("c"), F.sum("p").alias("s"))
    laid = histogram.select("lang", "a", "p", "c", "s", F.lit(None).cast("string").alias("b"))
    laid = laid.union(pairs.select("lang", "a", F.col("y").alias("p"), zero, zero, "b"))
    upto, whole = Window.partitionBy("lang", "a").orderBy("p"), Window.partitionBy("lang", "a")
    sums = [F.sum(c).over(w).alias(n) for c, w, n in (("c", upto, "below"), ("s", upto, "below_sum"), ("c", whole, "count"), ("s", whole, "sum"))]
    apart = laid.select("lang", "a", "b", "p", *sums).where("b IS NOT NULL")
    apart = apart.select("lang", "a", "b", (F.col("p") * (2 * F.col("below") - F.col("count")) + F.col("sum") - 2 * F.col("below_sum")).alias("apart"))
    apart = cut_lineage(apart)

    low, high = F.least("a", "b"), F.greatest("a", "b")
    halves = apart.groupBy("lang", low.alias("low"), high.alias("high")).agg(F.sum("apart").alias("apart"))
    base = (F.col("vocabulary") - F.col("n_a") - F.col("n_b")) * F.abs(F.col("x") - F.col("y"))
    value = pairs.select("lang", "a", "b", low.alias("low"), high.alias("high"), base.alias("base"))
    value = value.join(halves, ["lang", "low", "high"]).join(both.withColumnsRenamed({"a": "low", "b": "high"}), ["lang", "low", "high"], "left")
    total = F.coalesce(F.col("base") + F.col("apart") + F.coalesce("correction", zero), zero)
    between = value.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), total.alias("value"))
    between = between.withColumn("rank", F.row_number().over(best))
    return between.unionByName(over)
