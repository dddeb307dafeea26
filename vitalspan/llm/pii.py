"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The field reads windows of a text: runs of tokens with a digit or an ``@``. It scores whole
segments of up to ``LONGEST`` tokens for every type by features of the segment and the word in
front of it, and dynamic programming over segment ends chooses boundaries and types together.
It is fitted by maximum likelihood on the patterns' finds in a bounded sample of windows, some
of them rewritten without the marks that the patterns rest on. A segment it is sure of is added
where no pattern has found anything.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import slices
from vitalspan.llm.findings import Finding, sampled_findings

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most: 19 digits in pairs.
LONGEST = 10
#: Windows the field is fitted on at most, of those with and of those without a find.
SAMPLE_WINDOWS = 1_000
#: Rounds of made-up tokens that stand for no personal data in the fit.
CONTRAST = 60
SURE = 0.95
#: Characters of a segment at most; no longer text is personal data of these types.
WIDEST = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole, so no place inside one needs to be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _byte_sized(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """All finds of the patterns, by kind and start; code points, end exclusive."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte_sized, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_CUES = {
    0: re.compile(r"(?i)e-?mail|mail|contact|courriel|correo|write"),
    1: re.compile(r"(?i)\bip\b|host|server|addr|login"),
    2: re.compile(r"(?i)card|visa|karte|carte|tarjeta|pay"),
    3: re.compile(r"(?i)phone|tel|call|fax|mobil|ruf"),
}
_FEATURES = 33
_MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_EDGES = "()[]{}<>,;:.!?\"'"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The segment without the marks around it; an opening bracket of a number stays."""
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    while start < end and text[start] in _EDGES and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def features(segment: str, tokens: int, ahead: str, opens: bool, ends: bool) -> np.ndarray:
    """What a whole segment looks like; ``ahead`` is the word in front of it.

    ``opens`` and ``ends``: no token of the window comes before or after it.
    """
    digits = "".join(_DIGIT.findall(segment))
    n, size = len(digits), max(1, len(segment))
    letters = sum(c.isalpha() for c in segment)
    parts = segment.split(".")
    out = np.zeros(_FEATURES)
    out[0] = 1
    out[min(tokens, 4)] = 1
    out[5 + (0 if n < 4 else 1 if n < 7 else 2 if n < 9 else 3 if n < 13 else 4 if n < 20 else 5)] = 1
    out[11] = "@" in segment
    out[12] = bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]{2,}", segment))
    out[13] = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
    out[14] = out[13] and all(map(_byte_sized, parts))
    out[15] = 13 <= n <= 19 and luhn(digits)
    out[16] = segment.startswith("+")
    out[17] = letters > 0
    out[18] = letters / size
    out[19] = n / size
    out[20] = "-" in segment or "(" in segment
    groups = re.findall(r"[0-9]+", segment)
    out[21] = len(groups) == 4 and all(len(g) == 4 for g in groups)
    for k, cue in _CUES.items():
        out[22 + k] = bool(cue.search(ahead))
    out[26] = bool(_MIXED.search(segment))
    out[27] = len(groups) >= 4 and all(len(g) == 2 for g in groups[1:])
    out[28] = 9 <= n <= 15 and len(groups) > 2
    out[29] = tokens > 6
    out[30] = len(groups) >= 3 and len(groups[-1]) == 4 and len(groups[-2]) == 3
    out[31] = opens
    out[32] = ends
    return out


class Window:
    """A run of tokens with a digit or ``@``, and the features of all its segments."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], ahead: str):
        self.n = len(tokens)
        self.ends, self.places, rows = [], [], []
        for j in range(self.n):
            mine = []
            for i in range(j, max(-1, j - LONGEST), -1):
                a, b = trimmed(text, tokens[i][0], tokens[j][1])
                if b - a > WIDEST or b <= a:
                    continue
                before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ahead
                mine.append((i, len(rows)))
                rows.append(features(text[a:b], j - i + 1, before, i == 0, j == self.n - 1))
                self.places.append((a, b, i, j))
            self.ends.append(mine)
        self.x = np.array(rows).reshape(len(rows), _FEATURES)


def runs(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Runs of tokens with a digit or ``@``, and the word ahead of each."""
    if not _DIGIT.search(text) and "@" not in text:
        return
    run: list[tuple[int, int]] = []
    ahead, last, fresh = "", "", False
    for m in _TOKEN.finditer(text):
        token = m[0]
        if "@" in token or _DIGIT.search(token):
            if not run:
                ahead = last
            run.append(m.span())
            fresh = True
            if len(run) == 64:  # a table of numbers: windows overlap by the longest segment
                yield run, ahead
                run, fresh = run[-LONGEST:], False
        elif run:
            if fresh:
                yield run, ahead
            run, fresh = [], False
        last = token
    if fresh:
        yield run, ahead


def windows(text: str) -> Iterator[Window]:
    """The windows of a text; between two of them is a token without digit or ``@``."""
    for run, ahead in runs(text):
        yield Window(text, run, ahead)


def _forward(window: Window, scores: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all segmentations of each prefix; a lone token weighs 0."""
    log = np.full(window.n + 1, -np.inf)
    log[0] = 0.0
    for j in range(window.n):
        terms = [log[j]]
        for i, row in window.ends[j]:
            terms.append(log[i] + scores[row])
        log[j + 1] = np.logaddexp.reduce(terms)
    return log


def _marginals(window: Window, weights: np.ndarray) -> np.ndarray:
    """P(segment, type) under all segmentations."""
    s = window.x @ weights
    summed = np.logaddexp.reduce(s, axis=1) if len(s) else np.zeros(0)
    ahead = _forward(window, summed)
    behind = np.full(window.n + 1, -np.inf)
    behind[window.n] = 0.0
    for j in range(window.n - 1, -1, -1):
        behind[j] = np.logaddexp(behind[j], behind[j + 1])
        for i, row in window.ends[j]:
            behind[i] = np.logaddexp(behind[i], summed[row] + behind[j + 1])
    out = np.zeros_like(s)
    for j in range(window.n):
        for i, row in window.ends[j]:
            out[row] = np.exp(ahead[i] + s[row] + behind[j + 1] - ahead[window.n])
    return out


def best(window: Window, weights: np.ndarray) -> list[tuple[int, int]]:
    """(type, segment) of the best segmentation of a window."""
    s = window.x @ weights
    value, back = [0.0], []
    for j in range(window.n):
        top, via = value[j], None
        for i, row in window.ends[j]:
            k = int(np.argmax(s[row]))
            if value[i] + s[row, k] > top:
                top, via = value[i] + s[row, k], (i, k, row)
        value.append(top)
        back.append(via)
    out, j = [], window.n
    while j:
        via = back[j - 1]
        if via:
            out.append((via[1], via[2]))
        j = via[0] if via else j - 1
    return out


def _truth(window: Window, spans: list[Span]) -> np.ndarray:
    """1 for the segment that covers most of a span, if that is four fifths of it or more."""
    out = np.zeros((len(window.places), len(KINDS)))
    for kind, start, end in spans:
        inside = [(b - a, row) for row, (a, b, _, _) in enumerate(window.places) if start <= a + 1 and b - 1 <= end]
        if inside and max(inside)[0] >= 0.8 * (end - start):
            out[max(inside)[1], kind] = 1
    return out


def rewritten(kind: int, value: str, draw: np.random.Generator) -> str:
    """A phone or card number in a form that the patterns pass over; others stay as they are."""
    digits = "".join(_DIGIT.findall(value))
    if kind == 3:
        marks = [" ", " ", "-", "/"]
        groups = [digits[: len(digits) % 2 + 2]]
        groups += [digits[k : k + 2] for k in range(len(groups[0]), len(digits), 2)]
        if draw.random() < 0.5:
            marks, groups = [" ", ".", "-", "/"], [digits[:-7], digits[-7:-4], digits[-4:]]
        elif draw.random() < 0.3:
            return value.lstrip("+")
        return str(draw.choice(marks)).join(groups)
    if kind == 2:
        return str(draw.choice([".", "/", "_"])).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return value


def changed(text: str, draw: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with its finds rewritten, and where they stand now."""
    spans = sorted(base_spans(text), key=lambda s: s[1])
    if any(a[2] > b[1] for a, b in zip(spans, spans[1:])):
        return text, spans
    out, at, moved = "", 0, []
    for kind, a, b in spans:
        out += text[at:a]
        value = rewritten(kind, text[a:b], draw)
        moved.append((kind, len(out), len(out) + len(value)))
        out, at = out + value, b
    return out + text[at:], moved


def learned_from(text: str) -> Iterator[Finding]:
    """Each window with the word ahead of it; 1 where a pattern finds something in it, else 0."""
    for run, ahead in runs(text):
        piece = text[run[0][0] : run[-1][1]]
        yield int(bool(base_spans(piece))), f"{ahead} {piece}".encode("utf-8", "surrogatepass")


def fit_field(texts: list[str], seed: int = 5, rounds: int = 24) -> np.ndarray:
    """Weights of the field, features x types, from the patterns' finds in ``texts``."""
    draw = np.random.default_rng(seed)
    kept: list[tuple[Window, np.ndarray]] = []
    for text in texts:
        # Half of the texts' numbers lose their form but stay what they are.
        text, spans = changed(text, draw) if draw.random() < 0.5 else (text, base_spans(text))
        for window in windows(text):
            kept.append((window, _truth(window, spans)))
    # Contrast: numbers, versions, dates and codes that are nobody's data.
    letters, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    word = lambda alphabet, n: "".join(draw.choice(alphabet, n))
    for _ in range(CONTRAST):
        number, code = word(digits, draw.integers(1, 13)), word(letters + digits, draw.integers(6, 40))
        version = ".".join(word(digits, draw.integers(1, 3)) for _ in range(draw.integers(2, 4)))
        date = "-".join((word(digits, 4), word(digits, 2), word(digits, 2)))
        file = "-".join((word(digits, 3), word(digits, 2), word(digits, 4)))
        name = word(letters, 6)
        for token in (number, code, version, date, file, f"{name}={code}1", f"{name}:{number}", f"@{name}", f"{name}@"):
            kept += [(w, np.zeros((len(w.places), len(KINDS)))) for w in windows(f"{name} {token} {name}")]
    weights = np.zeros((_FEATURES, len(KINDS)))
    weights[0] = -4.0
    for step in range(rounds):
        rate = 0.3 / (1 + 0.1 * step)
        for k in draw.permutation(len(kept)):
            window, truth = kept[k]
            weights += rate * (window.x.T @ (truth - _marginals(window, weights)) - 0.0001 * weights)
    return weights


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those the field adds to them."""
    base = base_spans(text)
    added: list[Span] = []
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    last = 0  # windows of one run overlap
    for window in windows(text):
        free = []
        for kind, row in best(window, weights):
            a, b, _, _ = window.places[row]
            k = bisect_right(taken, a, key=lambda t: t[0])
            if not (k and taken[k - 1][1] > a) and not (k < len(taken) and taken[k][0] < b):
                free.append((a, b, kind, row))
        if free:
            sure = _marginals(window, weights)
            for a, b, kind, row in sorted(free):
                if sure[row, kind] >= SURE and a >= last:
                    added.append((kind, a, b))
                    last = b
    return base, added


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_windows: int = SAMPLE_WINDOWS
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of ``docs``.

    The counts and the digest are of the patterns' finds; ``spans`` also has the field's, as
    kind:start:end by kind, then start. NULL and empty texts have none. Repeated rows get the
    same spans; further columns are not read; no rows give none. The field is fitted on at most
    ``sample_windows`` distinct windows with a find and as many without, drawn from all whole
    texts; where none holds personal data, it adds nothing.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = sampled_findings(docs, learned_from, sample_windows)
    weights = fit_field([item.decode("utf-8", "surrogatepass") for _, item in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, joined = np.zeros((batch.num_rows, len(KINDS)), np.int64), [], []
            for k, one in enumerate(batch.column("text").fill_null("").to_pylist()):
                base, added = find(one, weights)
                for kind, _, _ in base:
                    counts[k, kind] += 1
                digests.append(hashlib.sha256(described(base).encode()).hexdigest())
                joined.append(described(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
