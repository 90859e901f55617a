"""Quality rules: word and repetition counts, then compression bands.

A text that zstandard shrinks better than prose is repetitive; one that it
shrinks less is noise: binary, base64 from 128 bytes, hashes in hex from 4 KiB
(shorter ones shrink as prose of their length does). Both limits depend on how
long the compressed stretch is, since short texts never compress well. The
ratio (bytes / compressed bytes) is taken over the whole document and over
fixed chunks; a document is rejected when the whole lies outside the band for
its length, or when chunks outside their bands make up too much of it.

Defined cases: a null or empty text has no words and fails the base rule; a
document of one chunk is judged as a whole only; repeated rows get the same
verdict each; an empty table gives an empty result; other columns, whatever
their names, are neither read nor changed. Bands belong to a corpus:
``fit_bands`` takes them from documents known to be good, the defaults from
ordinary prose; a length that few good documents have keeps the band it had.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, map_batches, narrow, texts_of

#: Characters that prose rarely needs.
SYMBOLS = "#*$%&|<>"


#: (bytes from, lowest, highest ratio) of ordinary prose: the documents labelled
#: good in sf0.1 that pass the base rule, whole, in stretches of each length and
#: in their chunks.
PROSE = (
    (64, 0.88, 1.33),
    (96, 0.92, 1.43),
    (128, 1.05, 1.52),
    (160, 1.10, 1.58),
    (192, 1.15, 1.66),
    (256, 1.24, 1.69),
    (320, 1.29, 1.77),
    (384, 1.35, 1.77),
    (512, 1.44, 1.90),
    (640, 1.47, 1.91),
    (768, 1.54, 2.00),
    (1024, 1.71, 2.03),
    (1280, 1.77, 2.12),
    (1536, 1.82, 2.15),
    (2048, 1.92, 2.17),
    (2560, 1.96, 2.20),
    (3072, 2.02, 2.24),
    (4096, 2.07, 2.30),
    (6144, 2.18, 2.34),
    (8192, 2.22, 2.41),
    (12288, 2.26, 2.42),
    (16384, 2.33, 2.48),
)
#: How far beyond ordinary prose the limits lie, as factors.
LOW_MARGIN, HIGH_MARGIN = 0.95, 1.10


@dataclass(frozen=True)
class QualityLimits:
    """``bands``: (bytes from, lowest ratio, highest ratio), ascending; the
    last band whose first field is not above a stretch's bytes holds for it.
    Below 64 bytes a ratio says nothing; no good document is longer than
    32 KiB, so beyond that the upper limit has a margin of a quarter.
    """

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    level: int = 3
    chunk_bytes: int = 4096
    max_bad_percent: int = 30
    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0),
        *((size, low * LOW_MARGIN, high * HIGH_MARGIN) for size, low, high in PROSE),
        (32768, 2.33 * LOW_MARGIN, 2.48 * 1.25),
    )


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_percent double"
)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs at least twice."""
    n = len(words)
    if n <= width:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    mixed = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - width + 1 + k].astype(np.uint64)
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Equal mixes may be chance, so windows get exact numbers, a word at a time.
    numbers, span = ids[: n - width + 1], len(index)
    for k in range(1, width):
        numbers = np.unique(numbers * span + ids[k : n - width + 1 + k], return_inverse=True)[1]
    twice = np.bincount(numbers)[numbers] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def in_band(size: int, compressed: int, limits: QualityLimits) -> bool:
    low, high = next((b[1], b[2]) for b in reversed(limits.bands) if b[0] <= size)
    return low <= size / compressed <= high


def compression(raw: bytes, compress, limits: QualityLimits) -> tuple[float, float, bool]:
    """Ratio of the whole, per cent of bytes in chunks outside their band, verdict."""
    if not raw:
        return 0.0, 0.0, False
    whole = len(compress(raw))
    fine = in_band(len(raw), whole, limits)
    bad = 0.0 if fine else 100.0
    if len(raw) > limits.chunk_bytes:
        chunks = (raw[i : i + limits.chunk_bytes] for i in range(0, len(raw), limits.chunk_bytes))
        bad = 100.0 * sum(len(c) for c in chunks if not in_band(len(c), len(compress(c)), limits)) / len(raw)
    return len(raw) / whole, bad, fine and bad <= limits.max_bad_percent


def measures_of(text: str, compress, limits: QualityLimits) -> tuple:
    """The values of ``MEASURES`` for one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = repeated_window_words(words, limits.window)
    failed = len(words) < limits.min_words or 100 * repeated > limits.max_repeat_percent * len(words)
    ratio, bad, fine = compression(raw, compress, limits)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        failed,
        fine and not failed,
        ratio,
        bad,
    )


def _measured(texts: list[str], compress, limits: QualityLimits) -> list[tuple]:
    return list(zip(*(measures_of(t, compress, limits) for t in texts), strict=True))


def stretch_ratios(text: str, compress, limits: QualityLimits) -> list[tuple[int, float]]:
    """(band's first bytes, ratio) of the whole, of its chunks, and of the beginning as long as each band's shortest text; none if the base rule fails."""
    raw = text.encode()
    words = raw.split()
    if len(words) < limits.min_words or 100 * repeated_window_words(words, limits.window) > limits.max_repeat_percent * len(words):
        return []
    starts = [b[0] for b in limits.bands if b[0] > 0]
    parts = [raw, *(raw[:n] for n in starts if n < len(raw))]
    if len(raw) > limits.chunk_bytes:
        parts += [raw[i : i + limits.chunk_bytes] for i in range(0, len(raw), limits.chunk_bytes)]
    return [(max(n for n in starts if n <= len(p)), len(p) / len(compress(p))) for p in parts if len(p) >= min(starts)]


def fit_bands(good: DataFrame, limits: QualityLimits = QualityLimits(), tail: float = 0.0005, least: int = 200, text_col: str = "text") -> QualityLimits:
    """``limits`` with bands as wide as the ratios of ``good`` documents, all but ``tail`` of them on either side, and the margins of the defaults.

    All documents and whole texts count. One job: ratios are taken where the
    texts lie, and only approximate percentiles, a row a band, reach the
    driver. A band of fewer than ``least`` stretches stays as it is in
    ``limits``, as does the one below the shortest length.
    """
    rows = narrow(good, text=text_col)

    def make():
        compress = zstandard.ZstdCompressor(level=limits.level).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [pair for t in texts_of(batch.column(0)) for pair in stretch_ratios(t, compress, limits)]
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found], pa.float64())], ["band", "ratio"])

        return step

    ends = F.percentile_approx("ratio", [tail, 1 - tail], 20_000).alias("ends")
    measured = map_batches(rows, make, "band long, ratio double").groupBy("band").agg(ends, F.count("*").alias("n")).where(F.col("n") >= least)
    fitted = {r.band: (r.band, r.ends[0] * LOW_MARGIN, r.ends[1] * HIGH_MARGIN) for r in measured.collect()}  # a row a band
    return replace(limits, bands=tuple(fitted.get(b[0], b) for b in limits.bands))


_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def measure_quality(docs: DataFrame, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``MEASURES``. No shuffle."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in MEASURES.split(", ")]]

    def make():
        compress = zstandard.ZstdCompressor(level=limits.level).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _measured(texts_of(batch.column(1)), compress, limits)
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(found, _TYPES, strict=True)]], names)

        return step

    return map_batches(rows, make, f"doc_id {kind}, {MEASURES}")


def keep_quality(docs: DataFrame, limits: QualityLimits = QualityLimits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they have. No shuffle."""
    at = docs.columns.index(text_col)

    def make():
        compress = zstandard.ZstdCompressor(level=limits.level).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [measures_of(t, compress, limits)[6] for t in texts_of(batch.column(at))]
            return batch.filter(pa.array(kept, pa.bool_()))

        return step

    return map_batches(docs, make, docs.schema)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(documents(spark, sf_dir))
