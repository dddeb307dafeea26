"""SentencePiece ids against the library."""

import random

import pytest
import sentencepiece
from conftest import rows
from test_edges import TEXTS, frame

from vitalspan.llm import pieces
from vitalspan.llm.queries import QUERIES, piece_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode(docs, piece_file(), decoded=True).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]] == (ids, library.decode(ids))
    assert QUERIES["op13_pieces"](spark, SF).count() == docs.count()


def test_random_texts_equal_the_library(library):
    made = pieces.loaded(piece_file())
    draw = random.Random(1)
    parts = ["▁", " ", "  ", "\n", "\t", "\r", "\x00", "a", "b", "e", "the", "in", "<s>", "<0x41>", "你", "é", "́", "😀", "ﬁ", "xx", "22", "'s", "...", "____", "　"]
    parts += [made.text[i] for i in draw.sample(sorted(made.text), 400)]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 12)))
        assert made.encode(text).tolist() == library.encode(text), text


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "ab" * 9_999 + "c", "=-" * 8_000, "不" * 5_000, "word " * 20_000])
def test_long_runs(library, text):
    assert pieces.loaded(piece_file()).encode(text).tolist() == library.encode(text)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 3)
    text = "the quick brown fox jumps over the lazy dog and over the quick brown fox"
    made = pieces.Pieces(piece_file())
    assert made.encode(text).tolist() == library.encode(text) and len(made.cache) <= 3 and len(made.pairs) <= 3


def test_pairs_are_compatible_where_the_library_keeps_them_apart(library):
    made = pieces.loaded(piece_file())
    draw = random.Random(2)
    tokens = [i for i in sorted(made.built) if "▁" not in made.text[i]]
    for _ in range(3000):
        a, b = draw.choice(tokens), draw.choice(tokens)
        whole = library.encode("\n" + made.text[a] + made.text[b])
        assert made.compatible(a, b) == (whole[-2:] == [a, b] and len(whole) == 4)


def test_edges(spark, library):
    got = pieces.encode(frame(spark), piece_file(), decoded=True)
    assert sorted((str(r["doc_id"]), str(r["ids"]), r["decoded"]) for r in got.collect()) == sorted(
        (str(i), str(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in TEXTS
    )
    assert pieces.encode(frame(spark, []), piece_file()).collect() == []
    back = pieces.decode(pieces.encode(frame(spark), piece_file()), piece_file())
    assert rows(back, "doc_id", "text") == rows(got, "doc_id", "decoded")


def test_other_models_are_refused():
    from public_tokenizers import path

    with pytest.raises(Exception):  # noqa: B017
        pieces.Pieces(path("byte_bpe_50k.json"))
