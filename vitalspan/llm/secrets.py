"""Secrets: fixed patterns, and a character convolutional network that adds to them.

The network reads every candidate, a long run of key characters, together with the characters
around it. It is fitted on all labelled findings (pieces of what the patterns found, against
pieces of candidates they did not), dealt to shards: in every round each shard takes steps of its
own over its findings, and the weights are averaged. A temperature is set on all findings left out
of the fit, and the threshold is the largest that still recalls ``RECALL`` of them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.prefix import rank_values
from vitalspan.llm.bytewords import slices
from vitalspan.llm.findings import Finding, every_finding
from vitalspan.session import cut_lineage

KINDS = ("assign", "access", "hex", "learned")
#: Findings of a shard, about, and how many of a label it should have where that label is rare.
SHARD, LEAST = 20_000, 64
ROUNDS, BATCH = 8, 64
RECALL = 0.95
#: Temperatures tried.
HEATS = np.geomspace(0.25, 8, 50)
#: Characters read of the candidate at a time, and on each side of it.
BODY, SIDE = 40, 16

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_WORD_BYTES = re.compile(rb"[A-Za-z]{3,}")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """All finds of the patterns; code points, end exclusive.

    A run of hexadecimal digits counts from its first digit, so only runs of 24 can match.
    """
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _DIGIT.search(text) or _HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of at least 12 key characters, a letter or digit among them."""
    return [m.span() for m in _CANDIDATE.finditer(text) if _ALNUM.search(m[0])]


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Rows of character codes: pieces of the candidate, each between the characters beside it.

    A candidate longer than ``BODY`` makes several rows, which cover all of it.
    """
    code = lambda s: np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 0x7F
    left, right = code(text[max(0, start - SIDE) : start]), code(text[end : end + SIDE])
    rows = []
    for at in range(start, end, BODY):
        row = np.zeros(2 * SIDE + BODY, np.uint8)
        row[SIDE - len(left) : SIDE] = left
        body = code(text[at : min(end, at + BODY)])
        row[SIDE : SIDE + len(body)] = body
        row[SIDE + BODY : SIDE + BODY + len(right)] = right
        rows.append(row)
    return np.array(rows)


class CharNet:
    """Embedding, one convolution, maxima over the sides and the body, one dense layer."""

    WIDTH, KERNEL, FILTERS = 8, 4, 24

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.p = [
            draw.normal(0, 0.3, (128, self.WIDTH)),
            draw.normal(0, 0.2, (self.KERNEL * self.WIDTH, self.FILTERS)),
            np.zeros(self.FILTERS),
            draw.normal(0, 0.2, 2 * self.FILTERS),
            np.zeros(1),
        ]
        self.p = [p.astype(np.float32) for p in self.p]
        self.moment, self.power = ([np.zeros_like(p) for p in self.p] for _ in range(2))
        self.steps, self.hot, self.threshold = 0.0, 1.0, np.inf

    def _maps(self, rows: np.ndarray) -> np.ndarray:
        """The convolution without its bias: rows x places x filters."""
        chars = self.p[0][rows].reshape(len(rows), -1)
        spread = np.lib.stride_tricks.sliding_window_view(chars, self.KERNEL * self.WIDTH, axis=1)[:, :: self.WIDTH]
        return (spread.reshape(-1, spread.shape[2]) @ self.p[1]).reshape(*spread.shape[:2], -1)

    def _pooled(self, inside: np.ndarray, around: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([inside, around], axis=1) + np.tile(self.p[2], 2), 0)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """The logit of every row."""
        maps = self._maps(rows)
        first, last = SIDE, SIDE + BODY - self.KERNEL + 1  # places inside the body
        around = np.maximum(maps[:, :first].max(axis=1), maps[:, last:].max(axis=1))
        return self._pooled(maps[:, first:last].max(axis=1), around) @ self.p[3] + self.p[4][0]

    def learn(self, rows: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> None:
        """One round of steps over all rows; both labels count alike, and the rarer one's rows come
        again until the other's have all been seen."""
        rare = int(2 * (y == 1).sum() < len(y))
        sides = [draw.permutation(np.flatnonzero(y == label)) for label in (1 - rare, rare)]
        share = min(BATCH // 2, max(BATCH // 4, BATCH * len(sides[1]) // len(y)))
        takes = (BATCH - share, share) if len(sides[1]) else (BATCH, 0)
        weight = np.repeat([0.5 / t if takes[1] else 1.0 / BATCH for t in takes if t], [t for t in takes if t]).astype(np.float32)
        for step in range(max(-(-len(side) // t) for side, t in zip(sides, takes) if t)):
            pick = np.concatenate([side.take(np.arange(step * t, step * t + t), mode="wrap") for side, t in zip(sides, takes) if t])
            self._step(self._gradients(rows[pick], y[pick], weight))

    def _step(self, grads: list[np.ndarray]) -> None:
        self.steps += 1
        for p, g, m, v in zip(self.p, grads, self.moment, self.power):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.004 * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def _gradients(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
        table, filters, _, dense, offset = self.p
        maps = self._maps(rows)
        first, last = SIDE, SIDE + BODY - self.KERNEL + 1
        index, each = np.arange(len(rows))[:, None], np.arange(self.FILTERS)
        ahead, inside, behind = (a + maps[:, a:b].argmax(axis=1) for a, b in ((0, first), (first, last), (last, maps.shape[1])))
        best = [inside, np.where(maps[index, behind, each] > maps[index, ahead, each], behind, ahead)]
        pooled = self._pooled(*(maps[index, at, each] for at in best))
        logit = pooled @ dense + offset[0]
        off = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * (1 / len(y) if weight is None else weight)
        off = off.astype(table.dtype)
        out = [np.zeros_like(p) for p in self.p]
        out[3], out[4] = pooled.T @ off, off.sum(keepdims=True)
        back = off[:, None] * dense * (pooled > 0)
        # What each character, at each place of the kernel, pulls at each filter.
        at = np.concatenate(best, axis=1)
        shape = (self.KERNEL, len(table), self.FILTERS)
        cells = [(k * len(table) + rows[index, at + k].astype(np.int64)) * self.FILTERS + np.tile(each, 2) for k in range(self.KERNEL)]
        pulls = np.bincount(np.stack(cells).ravel(), np.tile(back.ravel(), self.KERNEL), np.prod(shape)).reshape(shape).astype(table.dtype)
        out[2] += back.reshape(len(rows), 2, -1).sum((0, 1))
        for k, pull in enumerate(pulls):
            part = slice(k * self.WIDTH, (k + 1) * self.WIDTH)
            out[1][part] = table.T @ pull
            out[0] += pull @ filters[part].T
        return out

    def state(self) -> np.ndarray:
        """Weights, moments and steps as one array."""
        return np.concatenate([a.ravel().astype(float) for a in (*self.p, *self.moment, *self.power)] + [[float(self.steps)]])

    def restore(self, values: np.ndarray) -> None:
        at = 0
        for a in (*self.p, *self.moment, *self.power):
            a[...] = values[at : at + a.size].reshape(a.shape)
            at += a.size
        self.steps = float(values[at])

    def losses(self, logit: np.ndarray) -> np.ndarray:
        """Sums over findings of label 1, then of label 0: how many, and the loss at each temperature."""
        return np.array([float(len(logit)), *(np.logaddexp(0, -logit / h).sum() for h in HEATS)])

    def calibrate(self, losses: np.ndarray, lowest: float) -> None:
        """The temperature of least loss, both labels counting alike; the threshold at the logit
        ``lowest`` that still counts as recalled."""
        one, other = (np.asarray(part) for part in np.split(losses, 2))
        mean = one[1:] / max(one[0], 1.0) + other[1:] / max(other[0], 1.0)
        self.hot = float(HEATS[int(np.argmin(mean))])
        self.threshold = float(self.probability(np.array([lowest]))[0])

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(logit, float) / self.hot, -40, 40)))

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(rows[a : a + 512]) for a in range(0, len(rows), 512))])

    def score(self, pieces: list[np.ndarray]) -> np.ndarray:
        """A probability for every candidate: that of its likeliest piece."""
        if not pieces:
            return np.zeros(0)
        rows = np.concatenate(pieces)
        logit = self.logits(rows)
        first = np.cumsum([0] + [len(p) for p in pieces[:-1]])
        return self.probability(np.maximum.reduceat(logit, first))


def learned_from(text: str) -> Iterator[Finding]:
    """Pieces of every candidate: 1 where a pattern's find touches the piece, else 0.

    The value of an assignment also counts alone, as it would stand elsewhere.
    """
    spans = base_spans(text)
    ends = list(accumulate((e for _, _, e in spans), max))
    for a, b in candidates(text):
        for k, row in enumerate(encoded(text, a, b)):
            start, end = a + k * BODY, min(b, a + (k + 1) * BODY)
            before = bisect_left(spans, (end, -1, -1))  # finds that begin before the piece ends
            yield int(before > 0 and ends[before - 1] > start), row.tobytes()
    for s, kind, e in spans:
        if kind == 0:
            a = _ASSIGN.match(text, s).start(2)
            if e - a >= 12:
                for row in encoded(" " * SIDE + text[a:e], SIDE, SIDE + e - a):
                    yield 1, row.tobytes()


Parts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # rows and labels of the fit, and left out


def divided(labels: np.ndarray, items: list[bytes], first: np.ndarray, seed: list[int]) -> Parts:
    """A shard's findings with as many as a quarter of made-up ones, a fourth of both left out.

    A finding dealt to several shards is on the same side in all, and left out in its ``first`` only.
    """
    draw = np.random.default_rng(seed)
    rows = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), -1) if items else np.zeros((0, 2 * SIDE + BODY), np.uint8)
    # Contrast: numbered words, dates and paths, which the text may lack.
    words = sorted({w.decode() for row in rows for w in _WORD_BYTES.findall(row[:SIDE].tobytes())}) or ["text"]
    pick = lambda: words[int(draw.integers(len(words)))].lower()
    contrast = []
    for _ in range(max(40, len(rows) // 4)):
        made = (
            lambda: f"{pick()}-{pick()}-{draw.integers(99)}",
            lambda: f"{draw.integers(2000, 2030)}-{draw.integers(1, 13)}-{draw.integers(1, 29)}T{draw.integers(24)}",
            lambda: f"/{pick()}/{pick()}/{draw.integers(999)}",
            lambda: f"{pick()}{pick()}{draw.integers(9)}",
        )
        one = made[int(draw.integers(len(made)))]()
        contrast += list(encoded(f"{pick():>{SIDE}} {one} {pick()}", SIDE + 1, SIDE + 1 + len(one)))
    out = np.array([zlib.crc32(item) % 4 == 0 for item in items], bool)
    made_out = np.arange(len(contrast)) % 4 == 0
    x = np.concatenate([rows, np.array(contrast)])
    y = np.concatenate([labels, np.zeros(len(contrast))]).astype(np.float32)
    fit, left = np.concatenate([~out, ~made_out]), np.concatenate([out & first, made_out])
    return x[fit], y[fit], x[left], y[left]


def fit_network(findings: Iterable[Finding], seed: int = 9) -> CharNet:
    """The network on labelled pieces at hand, as one shard; see ``fit_on``."""
    findings = sorted(set(findings))
    labels = np.array([stratum for stratum, _ in findings], float)
    x, y, left, truth = divided(labels, [item for _, item in findings], np.ones(len(findings), bool), [seed, 0])
    net = CharNet()
    if min((y == 1).sum(), (truth == 1).sum()) >= 3:
        for number in range(ROUNDS):
            net.learn(x, y, np.random.default_rng([seed, 0, number]))
        logit = net.logits(left)
        found = np.sort(logit[truth == 1])
        net.calibrate(np.concatenate([net.losses(found), net.losses(-logit[truth == 0])]), found[int((1 - RECALL) * len(found))])
    return net


def total(parts: DataFrame) -> np.ndarray:
    """The sum of ``values`` over shards, in their order; 64 of them in a task."""

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        values = np.sum([np.asarray(v.values) for v in table.column("values")], axis=0)
        return pa.table([pa.array([table.column("shard")[0].as_py() // 64], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=["bucket", "values"])

    buckets = parts.withColumn("bucket", F.floor(F.col("shard") / 64)).groupBy("bucket").applyInArrow(added, "bucket int, values array<double>")
    return np.sum([np.array(r["values"]) for r in sorted(buckets.collect(), key=lambda r: r["bucket"])], axis=0)


def shards(pieces: DataFrame, seed: int) -> DataFrame:
    """(shard, x, y, left, truth): a row per shard, with its findings of the fit and those left out.

    Findings go to shards by their hash, those of a rare label to as many as need them, so shards
    do not depend on how the texts lie in tasks.
    """
    sizes = {r["stratum"]: r["count"] for r in pieces.groupBy("stratum").count().collect()}  # one per label
    many = max(1, -(-sum(sizes.values()) // SHARD))
    copies = {label: min(many, -(-LEAST * many // n)) for label, n in sizes.items()}
    often = F.when(F.col("stratum") == 1, copies.get(1, 1)).otherwise(copies.get(0, 1))
    spread = pieces.withColumn("copy", F.explode(F.sequence(F.lit(0), often - 1)))
    shard = F.pmod(F.pmod(F.xxhash64("item"), F.lit(many)) + F.col("copy"), F.lit(many)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("stratum", "ascending"), ("item", "ascending")])
        number = table.column("shard")[0].as_py()
        labels, first = table.column("stratum").to_numpy().astype(float), table.column("copy").to_numpy() == 0
        x, y, left, truth = divided(labels, table.column("item").to_pylist(), first, [seed, number])
        held = [x.tobytes(), y.astype(np.uint8).tobytes(), left.tobytes(), truth.astype(np.uint8).tobytes()]
        return pa.table([pa.array([number], pa.int32()), *(pa.array([h], pa.binary()) for h in held)], names=["shard", "x", "y", "left", "truth"])

    dealt = spread.withColumn("shard", shard).repartition(many, "shard")
    return cut_lineage(dealt.groupBy("shard").applyInArrow(run, "shard int, x binary, y binary, left binary, truth binary"))


def fit_on(docs: DataFrame, seed: int = 9) -> CharNet:
    """The network on all labelled pieces of ``docs``; one without a threshold where they lack a class.

    Every round each shard takes its steps from the same weights, and the shards' weights are
    averaged by their findings. The threshold is the exact quantile over all findings left out.
    """
    pieces = cut_lineage(every_finding(docs, learned_from))
    net = CharNet()
    if pieces.where("stratum = 1").isEmpty():
        return net
    stored = shards(pieces, seed)

    def held(batches: Iterator[pa.RecordBatch], rows: str, labels: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for number, x, y in zip(*(batch.column(c).to_pylist() for c in ("shard", rows, labels))):
                yield number, np.frombuffer(x, np.uint8).reshape(-1, 2 * SIDE + BODY), np.frombuffer(y, np.uint8).astype(np.float32)

    def packed(number: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=["shard", "values"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, y, truth in zip(*(batch.column(c).to_pylist() for c in ("shard", "y", "truth"))):
                yield packed(number, np.array([float(y.count(1)), float(truth.count(1))]))

    kind = "shard int, values array<double>"
    if total(stored.select("shard", "y", "truth").mapInArrow(counted, kind)).min() < 3:
        return net
    for number in range(ROUNDS):
        now = net.state()

        def learned(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, number: int = number) -> Iterator[pa.RecordBatch]:
            for shard, x, y in held(batches, "x", "y"):
                own = CharNet()
                own.restore(now)
                own.learn(x, y, np.random.default_rng([seed, shard, number]))
                yield packed(shard, np.append(own.state(), 1.0) * len(y))

        sums = total(stored.select("shard", "x", "y").mapInArrow(learned, kind))
        net.restore(sums[:-1] / sums[-1])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, x, y in held(batches, "left", "truth"):
            logit = net.logits(x)
            sums = np.concatenate([net.losses(logit[y == 1]), net.losses(-logit[y == 0])])
            columns = [pa.array([shard], pa.int32()), pa.array([sums], pa.list_(pa.float64())), pa.array([logit[y == 1]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "values", "found"])

    left = cut_lineage(stored.select("shard", "left", "truth").mapInArrow(scored, f"{kind}, found array<double>"))
    losses = total(left.select("shard", "values"))
    ranked = rank_values(left.select(F.explode("found").alias("logit")), "logit", descending=False)
    lowest = ranked.where(F.col("rank") <= int((1 - RECALL) * losses[0]) + 1).agg(F.max("logit")).first()[0]
    net.calibrate(losses, lowest)
    return net


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``.

    The counts and the digest are of the patterns' finds; ``spans`` also has the network's,
    of kind ``learned``, where they touch none of these: kind:start:end by start, then kind.
    NULL and empty texts have none. Repeated rows get the same spans; further columns are not
    read; no rows give none. The network is fitted on all distinct pieces of all whole texts;
    without findings to learn from, nothing is added.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    net = fit_on(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bases, open_spans, pieces = [], [], []
            for one in batch.column("text").fill_null("").to_pylist():
                base = base_spans(one)
                ends = list(accumulate((e for _, _, e in base), max))
                free = []
                for a, b in candidates(one):
                    before = bisect_left(base, (b, -1, -1))
                    if not before or ends[before - 1] <= a:
                        free.append((a, b))
                bases.append(base)
                open_spans.append(free)
                pieces += [encoded(one, a, b) for a, b in free]
            scores, at = net.score(pieces), 0
            counts, digests, joined = np.zeros((batch.num_rows, 3), np.int64), [], []
            for k, (base, free) in enumerate(zip(bases, open_spans)):
                mine = scores[at : at + len(free)]
                at += len(free)
                added = [(a, 3, b) for (a, b), p in zip(free, mine.tolist()) if p >= net.threshold]
                for _, kind, _ in base:
                    counts[k, kind] += 1
                digests.append(hashlib.sha256(described(base).encode()).hexdigest())
                joined.append(described(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
