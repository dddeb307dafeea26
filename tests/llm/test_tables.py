"""Registered queries on whole tables: oracle SQL, or a brute-force version."""

import hashlib
import importlib.util
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
from verify import rows_of  # noqa: E402

from vitalspan.llm import oracle, queries  # noqa: E402


@pytest.fixture(scope="module")
def base():
    found = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_oracle(spark, base, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = base.execute(oracle.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def documents(base):
    return base.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def digest(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(n))) for n in twice) % 10 == 0


def personal(text):
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255],
        "card": [
            m.span()
            for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(re.sub("[ -]", "", m[0])) <= 19 and luhn(re.sub("[ -]", "", m[0]))
        ],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15],
    }
    return {k: len(v) for k, v in found.items()}, [f"{k}:{a}:{b}" for k, v in found.items() for a, b in v]


def test_personal_data_keeps_every_base_span(spark, base):
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, SF).collect()}
    texts = documents(base)
    assert len(got) == len(texts)
    for doc_id, text in texts:
        counts, spans = personal(text or "")
        row = got[doc_id]
        assert {k: row[f"n_{k}"] for k in counts} == counts
        assert row["base_sha256"] == digest(spans)
        assert set(spans) <= set(row["spans"].split(","))


def secret(text):
    cases = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(cases, ("password", "passwd", "secret", "token")), cases("api") + "_?" + cases("key")])
    assign = rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_keep_every_base_span(spark, base):
    got = {r["doc_id"]: r for r in queries.op9_secrets(spark, SF).collect()}
    for doc_id, text in documents(base):
        found, row = secret(text or ""), got[doc_id]
        spans = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == kind for _, k, _ in found) for kind in range(3)]
        assert row["base_sha256"] == digest(spans)
        assert set(spans) <= set(row["spans"].split(","))


def coded(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_file())
    out, start = [], 0
    for doc_id, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, base):
    got = queries.op10_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == coded(documents(base))


@pytest.mark.parametrize("name, label, folds, held, least", [("op4_quality", "quality", 3, 1, 0.9), ("op8_toxicity", "toxic", 5, 0, 0.92)])
def test_held_out_accuracy(spark, base, name, label, folds, held, least):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    marked = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(p == y for p, y in marked) / len(marked) >= least


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_equals_its_stages_by_brute_force(spark, base):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    clean = pipeline.STAGES[0][1](spark, docs, SF)
    toxic = {r["doc_id"] for r in queries.op8_toxicity(spark, SF).collect() if r["predicted"]}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i, _ in documents(base)} - toxic

    left = base.execute("SELECT * FROM documents WHERE doc_id NOT IN (SELECT unnest(?)) ORDER BY doc_id", [list(toxic)]).to_arrow_table()
    small = duckdb.connect()
    small.register("documents", left)
    small.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    columns = ", ".join(docs.columns)
    for name in ("op3_jaccard", "op7_decontam"):
        keep = "doc_id = component_id" if name == "op3_jaccard" else "NOT contaminated"
        kept = small.sql(f"SELECT {columns} FROM documents JOIN (SELECT doc_id FROM ({oracle.ORACLES[name]}) WHERE {keep}) USING (doc_id)").to_arrow_table()
        small.register("documents", kept)
    mixed = small.sql(f"SELECT doc_id, text FROM ({oracle.ORACLES['op2_mixing']}) ORDER BY shuffle_key").fetchall()
    got = pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(coded(mixed))
    assert len(stages) == len(pipeline.STAGES) and Counter(i for i, _ in mixed)
