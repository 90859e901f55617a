"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two: as
many of ``max_len`` as fit, then one for each bit of the rest, longest first.
Each piece is a sequence of its own, so none crosses documents and none needs
padding; equal lengths form a bucket, from which a trainer draws batches with
a fixed number of tokens.

Defined cases: a null or empty text gives one piece, the end id alone;
repeated rows, null ids and equal ids are packed row by row, each with
sequence ids of its own; an empty table gives an empty result; other columns
are not read. Texts that hold an added token's string ("<|endoftext|>") are
encoded whole by the tokenizers library with its defaults, so the string gets
the token's id.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BoundedCache, documents, map_batches, narrow, texts_of

MAX_LEN = 1024
END_ID = 0


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class CachedTokenizer:
    """Ids of a byte-level BPE tokenizer file, remembered for each word.

    The file's pattern never lets a token run from a visible character into
    white space, so a text cut before single spaces and line feeds that
    follow visible characters encodes piece by piece. Texts with other white
    space, or with runs of it, are encoded whole. Where the file's ids follow
    the order of its merges, words go through the rank encoder, which gives
    the same ids several times faster; else through the file's own library.
    """

    _other = ("  ", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)
        self.words = BoundedCache(lambda w: self.whole(w if w[:1] == "\n" else " " + w))

    @staticmethod
    def _ranked(path: str) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters, vocab = _byte_letters(), told["model"]["vocab"]
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        in_order = [vocab["".join(m)] for m in merges] == list(range(256, 256 + len(merges)))
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not (in_order and plain and len(ranks) == 256 + len(merges)):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.ranked and not any(map(text.__contains__, self.added)):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text or not self.ranked or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, (*self._other, *self.added))):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))


def lengths_of(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of ``n`` tokens, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket.

    No shuffle. ``bucket`` is the sequence's length, a power of two.
    ``sequence_id`` joins the row's place in its partition with the bucket
    (its lowest five bits), so it needs no numbering over the whole table.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = CachedTokenizer(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            back, start, length, ids, tokens = [], [], [], [], []
            for row, text in enumerate(texts_of(batch.column(1))):
                raw = encode(text) + end
                n, at = len(raw) // 4, 0
                for size in lengths_of(n, max_len):
                    back.append(row)
                    start.append(at)
                    length.append(size)
                    ids.append(raw[4 * at : 4 * (at + size)])
                    tokens.append(n)
                    at += size
            longs = [pa.array(x, pa.int64()) for x in (start, length, tokens)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(back, pa.int64())), *longs[:2], pa.array(ids, pa.binary()), longs[2]], ["doc_id", "start", "length", "ids", "doc_tokens"])

        return step

    pieces = map_batches(rows, make, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        "*",
        (F.monotonically_increasing_id() * 32 + F.log2("length").cast("long")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Each bucket in its own folder, so that a reader of equal lengths opens only these files."""
    packed.write.partitionBy("bucket").parquet(path)


def pieces_of(docs: DataFrame) -> DataFrame:
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(documents(spark, sf_dir))
