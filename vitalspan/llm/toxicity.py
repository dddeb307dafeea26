"""Toxicity by weak supervision.

Voters (seed lexicons, lexicons and stems mined from labelled rows, patterns) each call a
document toxic, clean, or abstain. How often every combination of votes occurs is counted over
all documents; from these counts a generative model estimates each voter's accuracy by
expectation maximisation. Voters whose votes still depend on each other given the estimated
class are correlated: they become one joint voter and the model is fitted again. Its posteriors
label a bounded sample, on which a linear classifier over mined terms is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import PLAIN, SPACED, ByteWords, mix, slices, table_of, text_buffer
from vitalspan.llm.jaccard import shingle_sets
from vitalspan.llm.quality import is_held_out, training_rows
from vitalspan.session import cut_lineage

#: Labelled rows that terms are mined from and the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Terms the classifier may use.
TERMS = 4_096
STEMS = (4, 5, 6, 7)
#: A mined term is so many times likelier in toxic rows, and by chance with odds under exp(-18).
LIFT = 50
SURPRISE = 18.0
# Insults of everyday language, by language.
SEEDS = {
    "en": "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns bastard asshole bitch dumb filth vermin",
    "de": "idiot trottel arschloch abschaum dummkopf depp wichser hurensohn scheisse missgeburt penner",
    "fr": "idiot imbécile connard connasse salaud crétin abruti ordure merde pute débile",
    "es": "idiota imbécil estúpido cabrón puta basura gilipollas pendejo escoria mierda asqueroso",
}
_ABSTAIN, _CLEAN, _TOXIC = 0, 1, 2
_UPPER = table_of(lambda b: 0x41 <= b <= 0x5A)
_LOWER = table_of(lambda b: 0x61 <= b <= 0x7A)
_STEM_SALT = np.uint64(0x2545F4914F6CDD1D)


class Terms:
    """The words and stems of texts as hashes; a stem is the first 4 to 7 bytes of a longer word."""

    def __init__(self):
        self.words = ByteWords(PLAIN)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All terms, and the text each belongs to."""
        whole, start, end, bounds = self.words.of(data, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        found, owner = [whole], [text]
        for n in STEMS:
            longer = end - start > n
            # The first n bytes of every longer word, hashed from a fixed-width gather.
            at = start[longer]
            stem = np.full(len(at), n, np.uint64) * _STEM_SALT
            for k in range(n):
                stem = stem * np.uint64(0x100000001B3) + self.words.values[data[at + k]]
            found.append(mix(stem))
            owner.append(text[longer])
        return np.concatenate(found), np.concatenate(owner)


def word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = text_buffer(pa.array(words, pa.string()))
    return np.unique(ByteWords(PLAIN).of(data, offsets)[0])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in slices(batches, "text"):
        found, owner = terms.hashes(*text_buffer(batch.column("text")))
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        y = batch.column("y").to_numpy()
        # Tallied by batch before anything is shuffled.
        term, place = np.unique(found[fresh], return_inverse=True)
        toxic = np.bincount(place, y[owner[fresh]], len(term)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(toxic), pa.array(np.bincount(place, minlength=len(term)).astype(np.int64))], names=["term", "toxic", "n"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = ByteWords(SPACED)
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch, words)
        least = [[int(s.min().view(np.int64)), int(mix(s).min().view(np.int64))] if len(s) else [0, 0] for s in sets]
        marks = np.array(least, np.int64).reshape(len(least), 2)
        columns = [batch.column("text"), batch.column("y"), pa.array(marks[:, 0]), pa.array(marks[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, names=["text", "y", "one", "two"])


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of most groups of near copies, which else would vouch for each other's words."""
    signed = sample.mapInArrow(_signed, "text string, y int, one long, two long")
    for mark in ("one", "two"):
        signed = signed.groupBy(mark).agg(F.min(F.struct("text", "y", "one", "two")).alias("row")).select("row.*")
    return signed.select("text", "y")


def mine_terms(sample: DataFrame, rows: int, toxic_rows: int, at_most: int = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Terms that mark toxic rows of ``sample`` (text, y), and the strength of each."""
    if not 0 < toxic_rows < rows:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = sample.mapInArrow(_distinct, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = (F.col("toxic") + 0.5) / (toxic_rows + 1) / ((F.col("n") - F.col("toxic") + 0.5) / (rows - toxic_rows + 1))
    base, part = toxic_rows / rows, F.col("toxic") / F.col("n")
    # The bound on the chance that a term without bearing occurs in toxic rows so often.
    clean = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - base))).otherwise(0.0)
    surprise = F.col("n") * (part * F.log(part / base) + clean)
    strong = counts.where("toxic > 0").withColumn("lift", share).where((F.col("lift") >= LIFT) & (surprise >= SURPRISE))
    found = strong.orderBy(F.desc("lift"), F.desc("toxic"), "term").limit(at_most).select("term", "lift").toArrow()
    term, lift = found.column("term").to_numpy().view(np.uint64), found.column("lift").to_numpy()
    order = np.argsort(term)
    return term[order], np.log(lift[order])


@dataclass
class Voters:
    """The voters' lexicons as sorted hashes; the rest are patterns over them."""

    lexicons: list[np.ndarray]
    mined: np.ndarray

    @property
    def n(self) -> int:
        return len(self.lexicons) + 4

    def votes(self, batch: pa.RecordBatch, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of votes for every text; (text, term index) of the mined terms it holds."""
        data, offsets = text_buffer(batch.column("text"))
        found, owner = terms.hashes(data, offsets)
        rows = batch.num_rows
        out = np.zeros((rows, self.n), np.uint8)
        for k, lexicon in enumerate(self.lexicons):
            out[owner[_held(found, lexicon)], k] = _TOXIC
        hit = _held(found, self.mined)
        pairs = np.unique(owner[hit] * np.int64(len(self.mined) + 1) + np.searchsorted(self.mined, found[hit]))
        text, term = pairs // (len(self.mined) + 1), pairs % (len(self.mined) + 1)
        many = np.bincount(text, minlength=rows)
        k = len(self.lexicons)
        out[many >= 2, k] = _TOXIC
        out[many == 0, k + 1] = _CLEAN
        known = out[:, : len(SEEDS)].max(axis=1, initial=0)
        out[known == 0, k + 2] = _CLEAN
        part = data[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        tally = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[part])])[ends])
        upper, lower = tally(_UPPER), tally(_LOWER)
        out[(upper > lower) & (upper >= 20), k + 3] = _TOXIC  # shouting
        return out, text, term


def _held(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _code(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


class LabelModel:
    """P(toxic | votes) from counts of vote combinations, some of them with known class.

    ``groups`` has the voters that are read jointly; at first each stands alone.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 200, limit: float = 0.2):
        """``known`` has for each combination the labelled rows of class 0 and 1."""
        self.groups = [[k] for k in range(votes.shape[1])]
        self._fit(votes, counts, known, rounds)
        self.correlations = self._correlations(votes, counts)
        joined = self._joined(self.correlations, limit)
        if len(joined) < len(self.groups):
            self.groups = joined
            self._fit(votes, counts, known, rounds)

    def _symbols(self, votes: np.ndarray) -> list[np.ndarray]:
        return [_code(votes[:, g]) for g in self.groups]

    def _fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int) -> None:
        symbols = self._symbols(votes)
        self.tables: list[dict[int, np.ndarray]] = []
        coded = [np.unique(s, return_inverse=True) for s in symbols]
        share = (votes == _TOXIC).any(axis=1)
        belief = np.where(share, 0.9, 0.02)
        free = np.maximum(counts - known.sum(axis=1), 0)
        for _ in range(rounds):
            mass = np.stack([free * (1 - belief) + known[:, 0], free * belief + known[:, 1]])
            prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
            log = np.tile(np.log(prior)[:, None], (1, len(counts)))
            fitted = []
            for levels, place in coded:
                odds = np.stack([np.bincount(place, m, len(levels)) for m in mass]) + 0.1
                odds /= odds.sum(axis=1, keepdims=True)
                fitted.append((levels, odds))
                log += np.log(odds[:, place])
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
            done = np.abs(new - belief).max(initial=0) < 1e-6
            belief = new
            if done:
                break
        self.prior = prior
        self.tables = [dict(zip(levels.tolist(), odds.T)) for levels, odds in fitted]
        self.belief = belief

    def _correlations(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The largest correlation of two voters within a class."""
        out = np.zeros((votes.shape[1], votes.shape[1]))
        signs = np.choose(votes, [0.0, -1.0, 1.0])
        for weight in (counts * self.belief, counts * (1 - self.belief)):
            if weight.sum() < 1:
                continue
            centred = signs - np.average(signs, axis=0, weights=weight)
            cov = (centred * weight[:, None]).T @ centred / weight.sum()
            dev = np.sqrt(np.diag(cov))
            out = np.maximum(out, np.abs(cov / np.maximum(np.outer(dev, dev), 1e-9)))
        np.fill_diagonal(out, 0)
        return out

    @staticmethod
    def _joined(correlation: np.ndarray, limit: float, most: int = 3) -> list[list[int]]:
        """The most correlated voters together, up to ``most`` to a joint voter."""
        of = list(range(len(correlation)))
        groups = {k: [k] for k in of}
        pairs = np.argwhere(np.triu(correlation > limit, 1))
        for a, b in sorted(pairs.tolist(), key=lambda p: -correlation[p[0], p[1]]):
            if of[a] != of[b] and len(groups[of[a]]) + len(groups[of[b]]) <= most:
                keep, gone = of[a], of[b]
                groups[keep] += groups.pop(gone)
                of = [keep if x == gone else x for x in of]
        return [sorted(g) for g in groups.values()]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log(self.prior)[:, None], (1, len(votes)))
        for symbols, table in zip(self._symbols(votes), self.tables):
            levels, place = np.unique(symbols, return_inverse=True)
            log += np.stack([np.log(table[s]) if s in table else np.zeros(2) for s in levels.tolist()]).T[:, place]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def fit_linear(text: np.ndarray, term: np.ndarray, target: np.ndarray, start: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights and offset on the presence of terms, for soft targets."""
    weight, offset, n = start.astype(float).copy(), -3.0, max(1, len(target))
    seen = np.bincount(term, minlength=len(weight)) + 1.0
    positive = max(target.mean(), 1e-3) if len(target) else 1e-3
    for _ in range(rounds):
        z = np.bincount(text, weight[term], len(target)) + offset
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        # Steps are scaled by how often a term occurs, and held near the term's own strength.
        weight -= 0.5 * (np.bincount(term, off[text], len(weight)) / seen + 0.01 * (weight - start))
        offset -= 0.5 * off.sum() / (n * positive)
        offset = min(offset, -1.0)
    return np.maximum(weight, 0.0), offset


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    ``score`` is the linear classifier's probability of toxic, from the text alone;
    ``predicted`` is 1 from 0.5 on. NULL and empty texts hold no term and get the least score.
    Without labels of both kinds the seed lexicons alone vote. Repeated rows score alike; a
    NULL doc_id is not held out; further columns are not read; no rows give none.
    """
    score = fit(docs, labels, label, folds, held, sample_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch, terms))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; the same columns."""
    score = fit(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(score(batch, terms) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS):
    """A function from a batch with texts to scores."""
    chosen = training_rows(labels, label, folds, held, sample_rows)
    # ``sample_rows`` labels at most.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    sample = cut_lineage(without_copies(sample))
    rows, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if rows > sample_rows:  # several rows of ``docs`` share a labelled doc_id
        key = F.xxhash64("text")
        few = sample.select(key.alias("key")).orderBy("key").limit(sample_rows)
        sample = cut_lineage(sample.join(few, key == few["key"], "left_semi"))
        rows, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seeds = [word_hashes(words.split()) for words in SEEDS.values()]
    mined, strength = mine_terms(sample, rows, toxic)
    every = np.unique(np.concatenate([mined, *seeds]))
    start = np.full(len(every), 6.0)
    start[np.searchsorted(every, mined)] = np.clip(strength, 3.0, 8.0)
    # Mined terms vote in two halves, which err apart.
    halves = [mined[mined % np.uint64(2) == k] for k in range(2)]
    voters = Voters([*seeds, *halves], every)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(), {}
        for batch in slices(batches, "text"):
            votes, _, _ = voters.votes(batch, terms)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for code, times in zip(*np.unique(_code(votes) * 3 + y, return_counts=True)):
                total[code] = total.get(code, 0) + int(times)
        yield pa.RecordBatch.from_arrays([pa.array([int(c) for c in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    # y + 1 of rows of the sample, 0 of all others: counted over every document.
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce(F.col("y") + 1, F.lit(0)).cast("long").alias("y"))
    # At most 3 to the number of voters, few of which occur.
    found = marked.mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = found.column("code").to_numpy(), found.column("n").to_numpy().astype(float)
    combos, place = np.unique(code // 3, return_inverse=True)
    votes = (combos[:, None] // 3 ** np.arange(voters.n)) % 3
    counts = np.bincount(place, n, len(combos))
    known = np.stack([np.bincount(place, n * (code % 3 == k), len(combos)) for k in (1, 2)], 1) if len(combos) else np.zeros((0, 2))
    model = LabelModel(votes, counts, known) if len(combos) else None

    def label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches, "text"):
            votes, text, term = voters.votes(batch, terms)
            held_terms = np.split(term, np.searchsorted(text, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.array(model.posterior(votes)), pa.array(held_terms, pa.list_(pa.int64()))], names=["p", "terms"])

    weight, offset = start, -3.0
    if model is not None and rows:
        labelled = sample.select("text").mapInArrow(label_rows, "p double, terms array<long>").toArrow()
        target = labelled.column("p").to_numpy()
        held_terms = labelled.column("terms").combine_chunks()
        sizes = np.diff(held_terms.offsets.to_numpy())
        weight, offset = fit_linear(np.repeat(np.arange(len(target)), sizes), held_terms.flatten().to_numpy(), target, start)

    def score(batch: pa.RecordBatch, terms: Terms) -> np.ndarray:
        _, text, term = voters.votes(batch, terms)
        return 1 / (1 + np.exp(-np.clip(np.bincount(text, weight[term], batch.num_rows) + offset, -40, 40)))

    return score
