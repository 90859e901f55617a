"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists, for each end in a word, the vocabulary pieces
that end there, longest first; dynamic programming carries the best score and
its number of pieces, no path. The library's tie rules hold: scores are single
precision, a later (shorter) piece replaces an earlier one only if strictly
better, and a character that no piece of its own covers may be unknown at the
lowest score less 10. Unknown characters count one token a byte with byte
fallback, else one for each unbroken run.

Words are cut before a space mark that follows another character (no piece
runs across one), searched once and remembered. That is exact as long as sums
of scores are exact in single precision, which is checked: scores must be
multiples of one power of two, and a document whose sum is beyond 2**24 such
units is searched whole, rounding as the library does.

Defined cases: null and empty texts count 0; repeated rows count alike; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import struct

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, documents, map_batches, narrow, texts_of
from .piece_model import NORMAL, SPACE, UNIGRAM, USER_DEFINED, Normalizer, PieceModel, fields_of, read_model

#: Below the lowest score by this much lies the unknown character.
UNKNOWN_PENALTY = 10.0


def unigram_from_ranks(raw: bytes) -> bytes:
    """A unigram model file with the pieces of a merge-ranked one.

    The public files hold no unigram vocabulary, and none is trained here.
    The piece merged r-th gets Zipf's log-probability, -log2(r + 2), rounded
    to quarters; pieces outside the ranking (the runs of space marks) get the
    lowest. Everything else in the file stays.
    """
    out = bytearray()
    for number, value in fields_of(raw):
        if number == 1:
            found = dict(fields_of(value))
            if found.get(3, NORMAL) == NORMAL:
                rank = -struct.unpack("<f", found[2])[0] if 2 in found else 0.0
                score = -round(4 * math.log2(min(rank, 32766.0) + 2)) / 4
                value = _field(1, found[1]) + b"\x15" + struct.pack("<f", score)
            out += _field(1, value)
        elif number == 2:
            out += _field(2, value + b"\x18" + bytes([UNIGRAM]))  # the last value of a setting holds
        else:
            out += _field(number, value)
    return bytes(out)


def _field(number: int, value: bytes) -> bytes:
    size, head = len(value), bytearray([number << 3 | 2])
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    head.append(size)
    return bytes(head) + value


class UnigramCounter:
    """Number of tokens and best score of texts under one unigram model."""

    def __init__(self, model: PieceModel):
        if model.model_kind != UNIGRAM:
            raise ValueError("not a unigram model")
        self.model, self.normalize = model, Normalizer(model)
        scores = np.float32(model.scores)
        normal = [float(s) for s, k in zip(scores, model.kinds, strict=True) if k == NORMAL]
        self.unknown = float(np.float32(np.float32(min(normal)) - np.float32(UNKNOWN_PENALTY)))
        self.pieces = ahocorasick.Automaton()
        top = float(max(normal))
        for piece, score, kind in zip(model.pieces, scores, model.kinds, strict=True):
            if kind == NORMAL:
                self.pieces.add_word(piece, (len(piece), float(score)))
            elif kind == USER_DEFINED:
                self.pieces.add_word(piece, (len(piece), len(piece.encode()) * top - 0.1))
        self.pieces.make_automaton()
        self.unit = next((2.0**-k for k in range(13) if all((s * 2**k).is_integer() for s in normal)), 0.0)
        self.cut = model.words_stand_alone and self.unit and USER_DEFINED not in model.kinds
        self.words = BoundedCache(lambda w: self.search(w, exact=True))
        self._split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def search(self, text: str, exact: bool = False) -> tuple[int, float]:
        """(tokens, score) of normalised text in one search. exact: sums need no rounding."""
        n = len(text)
        best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        unknown, single = [False] * (n + 1), [False] * n
        settled = 0  # ends below this one have their best
        for end, (size, score) in self.pieces.iter(text):  # by end, longest first
            if settled < end:
                self._settle(text, settled, end, best, count, unknown, single, exact)
                settled = end
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1] = total if exact else float(np.float32(total))
                count[end + 1] = count[end + 1 - size] + 1
            if size == 1:
                single[end] = True
        self._settle(text, settled, n, best, count, unknown, single, exact)
        return count[n], best[n]

    def _settle(self, text, first, last, best, count, unknown, single, exact) -> None:
        """Let characters without a piece of their own be unknown."""
        for end in range(first, last):
            if not single[end]:
                total = best[end] + self.unknown
                if total > best[end + 1]:
                    best[end + 1] = total if exact else float(np.float32(total))
                    count[end + 1] = count[end] + (len(text[end].encode()) if self.model.byte_fallback else not unknown[end])
                    unknown[end + 1] = True

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        normal = self.normalize(text)[0].decode()
        if self.cut:
            found = list(map(self.words.__getitem__, self._split.findall(normal)))
            score = math.fsum(x[1] for x in found)
            # runs of unknown characters never join across words: a space mark stands between
            if abs(score) < self.unit * 2**24:
                return sum(x[0] for x in found), score
        return self.search(normal)


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, score (of the best segmentation). No shuffle."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, of fixed size

    def make():
        counter = UnigramCounter(read_model(shared.value))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [counter(t) for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "n_tokens", "score"])

        return step

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")


def op3_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = unigram_from_ranks(file.read())
    return count_tokens(documents(spark, sf_dir), model)
