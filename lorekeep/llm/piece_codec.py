"""SentencePiece encoding and decoding by vectorised merge rounds (operator 5).

The pieces of a BPE model never hold a space mark behind another character, so a text falls into words that merge
independently. All new words of a batch lie in one flat array of symbols. A round finds the best pair of every word
(highest score, then leftmost), merges it in all words at once, and compacts the array; where a merge can't make an
equal or better pair, all its places in a word merge in the same round. Words without a pair leave the array. A worker
remembers the ids of words, up to a bound. Decoding is the library's.

Defined results: a null text counts as empty and has the end id alone; characters without a piece become their bytes;
an empty table gives no rows; equal rows give equal results; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table

MARK = "▁"
REMEMBERED = 300_000
NONE = np.int64(1) << 40  # the rank of what is no pair


class Pieces:
    """The merge table of a model file, and the ids of words met so far."""

    _own: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = self.model = SentencePieceProcessor(model_file=path)
        self.size = size = m.vocab_size()
        usual = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.id_of = {m.id_to_piece(i): i for i in usual}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = np.array([m.get_score(i) for i in range(size)])
        self.rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = {}
        for piece, i in self.id_of.items():
            if MARK in piece.lstrip(MARK) or not set(piece) <= self.id_of.keys():
                raise ValueError(f"piece {piece!r} needs more than words and single characters")
            for k in range(1, len(piece)):
                left, right = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.to = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # A piece is strict if every pair that holds it ranks behind it.
        strict = np.ones(size, bool)
        for part in (self.keys // size, self.keys % size):
            strict[part[self.rank_of[self.to] <= self.rank_of[part]]] = False
        self.strict = strict
        self.apart = not any("\n" in p for p in self.id_of if len(p) > 1)
        self.known: dict[str, tuple[bytes, str]] = {"": (b"", "")}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def words(self, text: str) -> list[str]:
        """The words of the normalised text; those between are empty."""
        text = " " + text.replace(MARK, " ") if text else ""
        if "  " in text:
            text = re.sub(" +", lambda m: " " + MARK * len(m[0]), text)
        else:
            text = text.replace(" ", " " + MARK)
        return (text.replace("\n", " \n ") if self.apart else text).split(" ")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        to = np.where(self.keys[at] == key, self.to[at], -1)
        return np.where(to >= 0, self.rank_of[to], NONE), to

    def merged(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the word, its symbols) of all words, in the order in which they are done."""
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        chars, where = np.unique(points, return_inverse=True)
        # A character without a piece stays itself, beyond the ids.
        sym = np.array([self.id_of.get(chr(c), self.size + c) for c in chars.tolist()], np.int64)[where]
        word = np.repeat(np.arange(len(words)), lengths)

        def pairs_at(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            j = np.minimum(i + 1, len(sym) - 1)
            rank, to = self._pairs(sym[i], sym[j])
            off = (word[i] != word[j]) | (i == j)
            rank[off] = NONE
            return rank, to

        rank, to = pairs_at(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            over = least == NONE
            if over.any():
                for a, n in zip(first[over].tolist(), count[over].tolist()):
                    yield int(word[a]), sym[a : a + n]
                keep = np.repeat(~over, count)
                sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
                least, count = least[~over], count[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            # Of places that touch, every other one; of a piece that isn't strict, the leftmost place of the word.
            begins = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            leftmost = np.r_[True, word[at[1:]] != word[at[:-1]]]
            loose = np.zeros(len(leftmost), bool)
            if not self.strict[to[at]].all():
                bad = np.zeros(int(word[-1]) + 1, bool)
                bad[word[at[~self.strict[to[at]]]]] = True
                loose = bad[word[at]]
            at = at[np.where(loose, leftmost, nth % 2 == 0)]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            again = np.union1d(now, np.maximum(now - 1, 0))
            rank[again], to[again] = pairs_at(again)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {"": (b"", "")}
            fresh = [w for w in words if w]
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            for k, symbols in self.merged(some):
                ids = symbols.tolist()
                if max(ids) >= self.size:
                    ids = [x for s in ids for x in ([s] if s < self.size else [self.byte[b] for b in chr(s - self.size).encode()])]
                self.known[some[k]] = (np.array(ids, "<u4").tobytes(), " ".join(map(str, ids)))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of each text, also as decimal numbers joined by spaces."""
        split = [self.words(t) for t in texts]
        self.learn({w for words in split for w in words})
        for words in split:
            found = [self.known[w] for w in words if w]
            yield np.frombuffer(b"".join([f[0] for f in found]), "<u4").tolist(), " ".join([f[1] for f in found])


def encode(docs: DataFrame, model: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every text with the end id, and the text that they decode to."""
    return _run(docs, model, id_col, text_col, "doc_id long, ids array<int>, decoded string", lambda i, ids, text, decoded: (i, ids, decoded))


def digests(docs: DataFrame, model: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and texts are hashed where they are made."""

    def row(i, ids, text, decoded):
        return i, len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _run(docs, model, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    arrow_batches(docs.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in schema.split(", ")]
    arrow = pa.schema([(n, kinds[k]) for n, k in fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        end = pieces.model.eos_id()
        for batch in batches:
            out = []
            for i, (ids, text) in zip(batch.column(0).to_pylist(), pieces.encode(batch.column(1).to_pylist())):
                ids.append(end)
                out.append(row(i, ids, f"{text} {end}" if text else str(end), pieces.model.decode(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(task, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row of ``documents``."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
