"""Learning from a bounded sample of labelled documents, and scoring all documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, narrow, remainder_of_crc, runs_of, texts_of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, max_docs: int) -> list[tuple[str, int]]:
    """At most ``max_docs`` (text, label) pairs outside the held-out fold, by hash of the id.

    The chosen labels, a bounded number, are broadcast; texts are read in
    one scan without a shuffle.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder_of_crc(F.col("doc_id"), divisor) != held_out))
    chosen = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = narrow(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r["text"] or "", int(r["y"])) for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").collect()]


def score_documents(docs: DataFrame, model, divisor: int, held_out: int, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``model`` (of fixed size) is broadcast. No shuffle."""
    rows = narrow(docs, doc_id="doc_id", text="text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        score = shared.value.score_many

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for run in runs_of(texts_of(batch.column(1))) for s in score(run)], pa.float64())], ["doc_id", "score"])

        return step

    scored = map_batches(rows, make, f"doc_id {kind}, score double")
    held = F.coalesce(remainder_of_crc(F.col("doc_id"), divisor) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
