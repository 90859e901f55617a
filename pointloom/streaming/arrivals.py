"""Points that arrive as files: running counts, labelling by batch, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import apply_codes
from ..operators.tiling import CellGrid, TileGrid, count_grid
from ..plans.labelling import Model, label_planned, point_codes, with_codes
from ..session import checkpointed, qualified
from ..sources.las import register


def arrivals(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of ``path`` as they arrive; ``_metadata.file_path`` tells a row's file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def las_arrivals(spark: SparkSession, path: str, log: str, like: str | None = None) -> DataFrame:
    """LAS files of the folder ``path`` as they arrive; columns as of ``read_points``, idx counts inside a file.

    Each file comes exactly once, also after a restart: the folder ``log``
    keeps which files each batch has. ``like`` names a file with the
    dimensions that all have, for a folder that is still empty.
    """
    reader = register(spark).readStream.format("las").option("log", qualified(spark, log))
    return (reader.option("like", qualified(spark, like)) if like else reader).load(qualified(spark, path))


def stream_labels(points: DataFrame, model: Model, classes: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Labels arriving files, each planned and labelled by itself (``point_codes`` with ``options``): ``points`` with code, a folder a batch.

    A batch that is run again replaces its own folder. Points are told apart
    by path and idx.
    """

    def label(batch: DataFrame, batch_id: int) -> None:
        arrived = checkpointed(batch.withColumnRenamed("idx", "in_file").withColumn("idx", F.monotonically_increasing_id()))
        codes = point_codes(arrived, model, classes, by=("path",), **options)
        done = with_codes(arrived, codes, "code").drop("idx").withColumnRenamed("in_file", "idx")
        done.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _once(points.writeStream.foreachBatch(label), checkpoint)


def _once(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(points: DataFrame, grid: CellGrid, target: str, checkpoint: str) -> StreamingQuery:
    """Running count grid (cx, cy, n) of a stream; each batch replaces ``target`` with the whole grid (at most its cells)."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return _once(count_grid(points, grid).writeStream.outputMode("complete").foreachBatch(publish), checkpoint)


def stream_histogram(points: DataFrame, code: str, target: str, checkpoint: str) -> StreamingQuery:
    """Running class histogram (code, n)."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    counts = points.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    return _once(counts.writeStream.outputMode("complete").foreachBatch(publish), checkpoint)


def stream_classify(points: DataFrame, model: Model, classes: DataFrame, grid: TileGrid, buffer: float, target: str, checkpoint: str, budget: int = 4_000_000, by: str = "path") -> StreamingQuery:
    """Labels each batch of arriving files in tiles; a batch that is run again replaces its own folder.

    Files arrive whole, and each (column ``by``) is labelled by itself, so no
    point lacks neighbours that another batch brings. Dense tiles are cut
    until windows keep the ``budget``.
    """

    def label(batch: DataFrame, batch_id: int) -> None:
        arrived = checkpointed(batch)
        codes = apply_codes(label_planned(arrived, grid, model, buffer, budget, by=(by,)), classes)
        codes.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _once(points.writeStream.foreachBatch(label), checkpoint)


def stream_complete(points: DataFrame, files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """(file_id, n) of files whose declared count has arrived; more points than declared fail the stream."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        met = batch.join(files.select("file_id", "declared_count"), "file_id")
        over = F.raise_error(F.concat(F.lit("more points than declared in file "), F.col("file_id").cast("string"))).cast("long")
        n = F.when(F.col("n") > F.col("declared_count"), over).otherwise(F.col("n"))
        met.select("file_id", n.alias("n"), "declared_count").where("n = declared_count").select("file_id", "n").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    counts = points.groupBy("file_id").agg(F.count("*").alias("n"))
    return _once(counts.writeStream.outputMode("update").foreachBatch(publish), checkpoint)
