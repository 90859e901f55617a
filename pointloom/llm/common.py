"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_folder

__all__ = ["BoundedCache", "checkpointed", "documents", "fresh", "map_batches", "narrow", "remainder_of_crc", "runs_of", "shared_folder", "texts_of"]

#: ASCII white space that ends a word.
SPACES = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the keywords' names; other columns, however called, stay behind."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


#: Rows that a task turns into Python values at a time.
SLICE = 1024


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """``make()`` builds one function a task, which maps each Arrow batch, in slices, to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if step is None:
                step = make()
            for k in range(0, batch.num_rows, SLICE):
                yield step(batch.slice(k, SLICE))

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The column's strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def runs_of(texts: list[str], characters: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, in runs of about so many characters."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= characters:
            yield run
            run, held = [], 0
    if run:
        yield run


class BoundedCache(dict):
    """A dictionary of computed values that starts afresh beyond ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder_of_crc(column, divisor: int):
    """crc32 of the value as text, modulo ``divisor``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)
