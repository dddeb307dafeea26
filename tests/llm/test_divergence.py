"""Divergence of sources against a count by dictionaries."""

import random
import re
from collections import Counter

import pytest

from vitalspan.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, rank int"


def frame(spark, made):
    return spark.createDataFrame([(k, *r, "x", 1, 2) for k, r in enumerate(made)], SCHEMA)


def brute(made, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen = {}, {}
    for text, lang, source in made:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(set(words))
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, ps = p(sum(sources.values(), Counter())), {s: p(c) for s, c in sources.items()}
        for s in sources:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(ps[s][t] - q[t], t) for t in kept if sources[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, 50)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


def got(spark, made, least, **bounds):
    found = divergence.audit(frame(spark, made), least, **bounds)
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("bounds", [{}, {"block_postings": 20, "shard_bytes": 500, "held_pairs": 3}])
def test_equals_a_count_by_dictionaries(spark, bounds):
    draw = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["É", "é", "STRASSE", "straße", "東京", "x1y", "don't"]
    made = []
    for k in range(160):
        lang = draw.choice(["en", "de", None])
        weights = [1 / (1 + (j * (3 if lang == "de" else 5) + k % 4) % 50) for j in range(len(words))]
        made.append((" ".join(draw.choices(words, weights, k=draw.randrange(0, 40))), lang, draw.choice(["a", "b", "c", "d", None])))
    assert got(spark, made, 3, **bounds) == brute(made, 3)


def test_edges(spark):
    made = [(None, "en", "a"), ("", "en", "b"), ("one two two", "en", "c"), ("one two two", "en", "c"), ("1 2 3", "xx", "a"), (None, None, None)]
    made += [("ONE " + "two " * 300_000, "en", "d"), ("lone", "yy", "only")]
    assert got(spark, made, 2) == brute(made, 2)
    assert got(spark, [], 2) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "é".encode() * 50 + b" abc DEF" * 30 + b"x" * 40
    whole = [t for part in divergence.terms(text) for t in part]
    monkeypatch.setattr(divergence, "_PIECE", 7)
    assert [t for part in divergence.terms(text) for t in part] == whole


def test_runs_are_merged_into_one_order():
    import numpy as np
    import pyarrow as pa

    draw, want, documents, made = random.Random(8), Counter(), Counter(), []
    words = sorted(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}".encode() for k in range(300)) + ["é".encode(), "東京".encode()]
    for _ in range(200):
        source, some = draw.choice("abc"), sorted(draw.sample(words, draw.randrange(1, 40)))
        counts = [draw.randrange(1, 9) for _ in some]
        want.update({(t.decode(), source): n for t, n in zip(some, counts)})
        documents.update(t.decode() for t in some)
        made.append(("en", 0, source, b"\n".join(some), np.array(counts, "<i8").tobytes(), np.ones(len(some), "<i8").tobytes()))
    names = ["lang", "shard", "source", "terms", "counts", "documents"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
    got = divergence._merged(10)(table).to_pylist()
    assert not hasattr(divergence, "merge")  # postings do not pass through Python one by one
    kept = {k: n for k, n in want.items() if documents[k[0]] >= 10}
    assert {(r["term"], r["source"]): r["n"] for r in got} == kept and 0 < len(kept) < len(want)
    assert all(r["total"] == sum(n for (t, _), n in want.items() if t == r["term"]) for r in got)
    assert [r["term"] for r in got] == sorted((r["term"] for r in got), key=str.encode)
    assert divergence._merged(1)(table.slice(0, 0)).num_rows == 0
