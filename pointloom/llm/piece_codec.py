"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised by longest prefixes through the model's compiled
character map; the source byte of each output byte is kept. The normalised
text is cut before every space mark that follows another character (no piece
of such a model runs across one; other models take the text whole), each
distinct word is merged once by the library and remembered, and every piece
is projected through the alignment to the bytes of the original it stands for.

Defined cases: a null text counts as empty and has only the begin and end
ids; a piece that the normaliser put in (the leading space) has an empty span;
byte pieces of an unknown character span that whole character each; texts
with NUL or the space mark itself are ordinary; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, narrow, runs_of, texts_of
from .piece_model import BYTE, SPACE, UNKNOWN, Normalizer, read_model


#: Normalizer settings 3, 4 and 5 (prefix, extra spaces, escape) all off: appended
#: to a model file they override its own, since words come normalised.
NO_CHANGES = b"\x1a\x06\x18\x00\x20\x00\x28\x00"


#: Distinct words whose pieces a task remembers.
WORDS_HELD = 400_000


class OffsetEncoder:
    """Ids and original byte spans of texts under one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.model = read_model(raw)
        self.normalize = Normalizer(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self._merge = sentencepiece.SentencePieceProcessor(model_proto=raw + NO_CHANGES)
        self.alone = self.model.words_stand_alone and not self.model.char_map
        self.sizes = np.array([len(p.encode()) if k != BYTE else 1 for p, k in zip(self.model.pieces, self.model.kinds, strict=True)], np.int64)
        self.unknown = self.model.kinds.index(UNKNOWN) if UNKNOWN in self.model.kinds else -1
        self.begin = np.array([self.library.bos_id()], "<u4").tobytes()
        self.end = np.array([self.library.eos_id()], "<u4").tobytes()
        self.words: dict[str, bytes] = {}
        self._cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.simple = self.alone and self.model.add_prefix and self.model.escape and not self.model.remove_extra and self.normalize.own is None

    def _ids(self, word: str) -> bytes:
        return np.array(self._merge.encode(word), "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Merge the words not seen yet, in one call."""
        if len(self.words) > WORDS_HELD:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for word, ids in zip(new, self._merge.encode(new, num_threads=1) if new else [], strict=True):
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> list[str] | None:
        """The normalised text's words, or None where it must be merged whole."""
        if not self.alone:
            return None
        if self.simple and text and "  " not in text and text[0] != " " and SPACE not in text:
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        return self._cut.findall(self.normalize(text)[0].decode())

    def many(self, texts: list[str]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text: ids with begin and end, little-endian unsigned 32-bit, and each id's [begin, end) in the original's UTF-8."""
        words = [self._words(t) for t in texts]
        self._learn(set().union(*(w for w in words if w is not None)))
        get = self.words.__getitem__
        return [self._spans(t, self._whole(t) if w is None else b"".join(map(get, w))) for t, w in zip(texts, words, strict=True)]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        return self.many([text])[0]

    def _whole(self, text: str) -> bytes:
        if self.model.char_map:  # the library has the same map; the alignment is ours
            return np.array(self.library.encode(text), "<u4").tobytes()
        return self._ids(self.normalize(text)[0].decode())

    def _spans(self, text: str, body: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        normal, source = self.normalize(text)
        ids = np.frombuffer(body, "<u4")
        sizes = self.sizes[ids]
        if self.unknown >= 0 and not self.model.byte_fallback and self.unknown in ids:
            sizes = self._library_sizes(text)
        at = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        if at[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        edges = source[at]
        begins, ends = edges[:-1], edges[1:].copy()
        for k in np.flatnonzero(ends == begins):  # a byte inside a character, or the prefix
            stop = at[k + 1]
            if stop > len(self.normalize.mark) or not self.model.add_prefix or self.model.space_as_suffix:
                after = np.flatnonzero(source[stop:] > begins[k])
                ends[k] = source[stop + after[0]] if len(after) else source[-1]
        edge = np.array([0, source[-1]])
        return self.begin + body + self.end, np.concatenate([edge[:1], begins, edge[1:]]), np.concatenate([edge[:1], ends, edge[1:]])

    def _library_sizes(self, text: str) -> np.ndarray:
        return np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)], np.int64)


def encode(docs: DataFrame, model_path: str, decode: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, span_begin, span_end, decoded, n_spanned.

    ids, span_begin and span_end are binary, little-endian unsigned 32-bit
    (``unpack`` makes arrays of them); spans are byte offsets into the
    original UTF-8, and ``n_spanned`` counts those that are not empty.
    ``decoded`` is what the library makes of the ids (null unless asked for).
    No shuffle.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = OffsetEncoder(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [x for run in runs_of(texts_of(batch.column(1))) for x in encoder.many(run)]
            ids = [x[0] for x in found]
            spans = [pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (1, 2)]
            back = [encoder.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids] if decode else [None] * len(ids)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *spans, pa.array(back, pa.string()), pa.array([int((x[1] != x[2]).sum()) for x in found], pa.int64())],
                ["doc_id", "n_tokens", "ids", "span_begin", "span_end", "decoded", "n_spanned"],
            )

        return step

    return map_batches(rows, make, f"doc_id {kind}, n_tokens long, ids binary, span_begin binary, span_end binary, decoded string, n_spanned long")


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def span_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, digests of ids, decoded text and spans, n_spanned."""
    spans = F.sha2(F.concat("span_begin", "span_end"), 256).alias("spans_sha256")
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), spans, "n_spanned")


def op6_offset_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))
