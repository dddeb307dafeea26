"""URL rules as one bit-parallel wildcard automaton.

A rule is a glob over a canonical URL. All globs are packed into the bits of a few 64-bit
words: a bit stands for having matched so many of a glob's characters, and one shift, two ANDs
and an OR advance every glob by one byte. Words of all URLs of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import slices, text_buffer

#: Stands between host and path in a canonical URL; a ``*`` of the host does not cross it.
_SPLIT = "\n"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, with paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> tuple[str, str]:
        return "*." + self.host, self.path + "*"


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: (host glob, path glob): what to block where no rule fits; everything else is let through.
BLOCKED = tuple((f"*{word}*", "*") for word in ("spam", "pills", "casino", "viagra", "porn", "xxx", "payday", "warez")) + (
    ("", "*"),  # no host
    ("*", "*/wp-login.php*"),
    ("*", "*/cgi-bin/*"),
)


class Automaton:
    """Globs (host, path) with ``*`` for any run of bytes and ``?`` for one byte.

    A ``*`` or ``?`` in the host part stands for bytes of the host only. States of a glob lie
    side by side, one more than it has characters, and may run over the edge of a word.
    """

    def __init__(self, globs: Sequence[tuple[str, str]]):
        steps: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        every, host = np.ones(256, bool), np.ones(256, bool)
        host[ord(_SPLIT)] = False
        none = np.zeros(256, bool)
        for pair in globs:
            eat, stay = [none], [none]
            for part, wild in zip((pair[0], _SPLIT, pair[1]), (host, host, every)):
                for byte in part.encode():
                    if byte == ord("*"):
                        stay[-1] = stay[-1] | wild
                        continue
                    one = none.copy()
                    one[byte] = True
                    eat.append(wild if byte == ord("?") else one)
                    stay.append(none)
            steps.append((eat, stay))
        bits = sum(len(e) for e, _ in steps)
        self.width = max(1, -(-bits // 64))
        self.eat = np.zeros((256, self.width), np.uint64)
        self.stay = np.zeros((256, self.width), np.uint64)
        self.start = np.zeros(self.width, np.uint64)
        self.final, at = [], 0
        for eat, stay in steps:
            self.start[at // 64] |= np.uint64(1) << np.uint64(at % 64)
            for e, s in zip(eat, stay):
                bit = np.uint64(1) << np.uint64(at % 64)
                self.eat[e, at // 64] |= bit
                self.stay[s, at // 64] |= bit
                at += 1
            self.final.append(at - 1)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and glob, whether the glob matches the whole text."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        start, size = offsets[:-1][order], size[order]
        state = np.tile(self.start, (len(size), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(size)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -step, "left"))  # texts with a byte left
            byte = data[start[:live] + step]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.eat[byte]) | (now & self.stay[byte])
        out = np.empty((len(size), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one > 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path; both empty for NULL and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, blocked: Sequence[tuple[str, str]] = BLOCKED, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rule`` is the longest of ``rules`` that fits (ties: the first listed), NULL if none
    does; then ``verdict`` is block if one of ``blocked`` matches, else allow. NULL and
    malformed URLs have an empty host, which the default ``blocked`` blocks. Line breaks in a
    URL are matched as blanks. Columns of ``pages`` with the new names are replaced; repeated
    rows stay; no rows give none.
    """
    made = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in made]
    host, path = host_and_path(F.col(url))
    whole = "_" * (1 + max(map(len, pages.columns)))
    plain = lambda c: F.translate(c, "\n", " ")
    ready = pages.select("*", host.alias(whole + "h"), path.alias(whole + "p"))
    dotted = F.when(F.col(whole + "h") != "", F.concat(F.lit("."), F.col(whole + "h"))).otherwise("")
    canonical = F.concat(plain(dotted), F.lit(_SPLIT), plain(F.col(whole + "p")))
    ready = ready.select(*keep, F.col(whole + "h").alias("host"), F.col(whole + "p").alias("path"), canonical.alias(whole))
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    ordered = [rules[i] for i in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([*(r.glob for r in ordered), *blocked])
        names = np.array([*(r.name for r in ordered), None], object)
        verdicts = np.array([r.verdict for r in ordered], object)
        for batch in slices(batches, whole):
            hits = automaton.run(*text_buffer(batch.column(whole)))
            fits, bad = hits[:, : len(ordered)], hits[:, len(ordered) :].any(axis=1)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ordered)) if ordered else np.zeros(len(bad), int)
            verdict = np.where(bad, "block", "allow").astype(object)
            ruled = first < len(ordered)
            verdict[ruled] = verdicts[first[ruled]]
            columns = [batch.column(c) for c in (*keep, "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[first], pa.string()), pa.array(verdict, pa.string())], names=[*keep, *made]
            )

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return ready.mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")
