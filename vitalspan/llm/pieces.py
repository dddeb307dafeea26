"""SentencePiece encoding by a table of prefixes, and decoding.

Merging symbols greedily by score has two consequences. Cutting the last token off an encoding
leaves the encoding of what remains, so each prefix of a text has one last token. And tokens
stand side by side in an encoding exactly where no merge across their border comes first while
both are being put together; whether it does is a property of the two alone. So one pass over
a text with an automaton of all pieces finds, for each prefix, the one piece ending there that
is compatible with the last token of the prefix before it. The ids are then read backwards.

A border between characters that stand side by side in no piece is never merged across. Texts
are cut at such borders into words, which are looked up among those met before.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.bytewords import slices

SPACE = "▁"
#: Words kept with their ids, and pairs of tokens kept with their verdicts, in a worker.
CACHE_WORDS = 600_000
CACHE_PAIRS = 500_000
#: Longer runs without a border are encoded each time.
LONGEST_WORD = 48


class Pieces:
    """The encoder of one byte-pair model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model_file)
        self.size = sp.piece_size()
        every = range(self.size)
        if any(sp.is_unused(i) for i in every):
            raise ValueError(f"{model_file}: models with unused pieces are not supported")
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        alphabet = {c for piece in self.score for c in piece}
        if not alphabet <= set(self.score):
            raise ValueError(f"{model_file}: characters without a piece of their own are not supported")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError(f"{model_file}: models without byte fallback are not supported")

        self.built = {i: steps for i in plain if (steps := self._build(self.text[i])) is not None}
        self.automaton = ahocorasick.Automaton()
        for i in self.built:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        self.beside = {piece[k : k + 2] for piece in self.score for k in range(len(piece) - 1)}
        known = "".join(sorted(re.escape(c) for c in alphabet - {SPACE}))
        # Words begin with their spaces, unless pieces have spaces in their midst.
        split = not any(b[1] == SPACE != b[0] for b in self.beside)
        word = f"{SPACE}+[{known}]*|[{known}]+" if split else f"[{known}{SPACE}]+"
        self.words = re.compile(f"{word}|.", re.DOTALL)
        self.alphabet = alphabet
        self.cache: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        for probe in (" ".join(self.text[i] for i in plain[k::97]).replace(SPACE, " ") for k in range(0, 97, 16)):
            if self.encode(probe).tolist() != sp.encode(probe):
                raise ValueError(f"{model_file}: not a byte-pair model")

    def _build(self, piece: str) -> tuple[list, list, list] | None:
        """How a piece comes about: scores of its merges, its first and its last symbols."""
        symbols, scores = list(piece), []
        firsts, lasts = [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            found = [(self.score.get(symbols[k] + symbols[k + 1]), -k) for k in range(len(symbols) - 1)]
            best = max((f for f in found if f[0] is not None), default=None)
            if best is None:
                return None  # merging never ends in this piece
            k = -best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            scores.append(best[0])
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return scores, firsts, lasts

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those within the two tokens.

        Of equal scores the leftmost merge comes first.
        """
        mine, _, ends = self.built[left]
        theirs, starts, _ = self.built[right]
        i = j = 0
        while True:
            across = self.score.get(ends[i] + starts[j])
            a = mine[i] if i < len(mine) else None
            b = theirs[j] if j < len(theirs) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                good = False
                break
            if a is None and b is None:
                good = True
                break
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left * self.size + right] = good
        return good

    def _table(self, run: str) -> list[int]:
        """The ids of a run of known characters, by the last token of each of its prefixes."""
        last, size = [None] * len(run), [0] * len(run)
        pairs, count = self.pairs, self.size
        for end, (token, length) in self.automaton.iter(run):
            if last[end] is None:
                if length <= end:
                    before = last[end - length]
                    if before is None:
                        continue
                    fits = pairs.get(before * count + token)
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                last[end], size[end] = token, length
        ids, at = [], len(run) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        if word[0] not in self.alphabet:
            ids = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
            return array("i", ids).tobytes()
        out, at, beside = [], 0, self.beside
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in beside:
                out.append(self._run(word[at:k]))
                at = k
        out.append(self._run(word[at:]))
        return b"".join(out)

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            ids = array("i", self._table(run)).tobytes()
            if len(run) <= LONGEST_WORD:
                if len(self.runs) >= CACHE_WORDS:
                    self.runs.clear()
                self.runs[run] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, those of the library's ``encode``."""
        out, cache = [], self.cache
        for word in self.words.findall(self.library.normalize(text)):
            ids = cache.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= LONGEST_WORD:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=1)
def loaded(model_file: str) -> Pieces:
    """The encoder, kept by a worker for its next tasks."""
    return Pieces(model_file)


def _encoded(model_file: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            pieces = loaded(model_file)
            ids = [pieces.encode(t or "") for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids), pa.int32())
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            names = ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array([pieces.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _decoded(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            texts = [None if ids is None else library.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row; with ``decoded`` also the ids' text.

    The ids are those of the sentencepiece library without begin and end ids. ``model_file``
    is a byte-pair model with byte fallback that all executors can read; any other raises.
    NULL and empty texts have no ids and decode to the empty text. Every row of ``docs``, a
    repeated one too, has its row in the result, with its doc_id as it is, NULL included.
    Further columns are not read. No rows give none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + (", decoded string" if decoded else "")
    return rows.mapInArrow(_encoded(model_file, decoded), schema)


def decode(tokens: DataFrame, model_file: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; NULL ids give a NULL text."""
    rows = tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(model_file), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
