"""File catalogues: listing, totals, output names, and checks between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reordered copies for viewing are no inputs.
VIEW_COPY = ".qgis-view.copc.laz"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of .las and .laz files in ``folder``, in order of path; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sSzZ]").load(folder)
    rows = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(~F.lower("path").endswith(VIEW_COPY)).distinct().orderBy("path")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_info(files: DataFrame) -> DataFrame:
    """(folder, n_files, points, size_mb)."""
    return files.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("declared_count").alias("points"), F.round(F.sum("size_mb"), 4).alias("size_mb"))


def output_path(path: Column, folder: str, suffix: str) -> Column:
    """Where the result of ``path`` goes: .copc is dropped from the name, .las stays .las, all else is .laz."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?i)\.copc$", "")
    return F.concat(F.lit(f"{folder}/"), stem, F.lit(suffix), F.when(F.lower(name).endswith(".las"), ".las").otherwise(".laz"))


def check_outputs(plan: DataFrame) -> DataFrame:
    """(out, reason) of a plan (path, out) that must not run: two results in one place, or a result over an input. Case ignored."""
    twice = plan.groupBy(F.lower("out").alias("out")).agg(F.count("*").alias("n")).where("n > 1").select("out", F.lit("several results").alias("reason"))
    inputs = plan.select(F.lower("path").alias("out")).distinct()
    over = plan.select(F.lower("out").alias("out")).join(inputs, "out", "left_semi").distinct().select("out", F.lit("an input").alias("reason"))
    return twice.unionByName(over)


def files_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose (size, modified) differ between two listings, or that only one has."""
    old = before.select("path", F.struct("size", "modified").alias("old"))
    new = after.select("path", F.struct("size", "modified").alias("new"))
    return old.join(new, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path")


def verify_counts(points: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, declared_count, n) of files whose points are not as many as declared."""
    counts = points.groupBy("file_id").agg(F.count("*").alias("n"))
    return files.join(counts, "file_id", "left").select("file_id", "declared_count", F.coalesce("n", F.lit(0)).alias("n")).where("declared_count <> n")


def verify_written(written: DataFrame, source: DataFrame) -> DataFrame:
    """One row: n_in, n_out, complete."""
    return source.agg(F.count("*").alias("n_in")).crossJoin(written.agg(F.count("*").alias("n_out"))).withColumn("complete", F.col("n_in") == F.col("n_out"))


def bounds_audit(points: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, holds): whether the declared bounds hold every point of the file."""
    true = points.groupBy("file_id").agg(*[f(c).alias(f"t{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    holds = F.lit(True)
    for c in "xy":
        holds = holds & (F.col(f"tmin_{c}") >= F.col(f"min_{c}")) & (F.col(f"tmax_{c}") <= F.col(f"max_{c}"))
    return files.join(true, "file_id").select("file_id", holds.alias("holds"))


def _refusal() -> Column:
    return F.when(F.coalesce("waveforms", F.lit(False)), "waveform packets").when(F.coalesce("angular", F.lit(False)), "coordinates in degrees")


def refused(files: DataFrame) -> DataFrame:
    """(path, reason) of files that cannot be labelled: waveform packets, or coordinates in degrees."""
    return files.select("path", _refusal().alias("reason")).where("reason is not null")


def refuse_waveforms(files: DataFrame) -> DataFrame:
    """``files``; one that ``refused`` would list fails the job."""
    bad = _refusal()
    path = F.when(bad.isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": "), bad)).cast("string"))
    return files.withColumn("path", path)


def write_tiles(assigned: DataFrame, path: str) -> None:
    """x, y, z, idx of each tile in a folder of its own; one tile is read by partition pruning.

    Rows are dealt by ranges of tile, then point, with sampled bounds, so tasks
    are about equal: a full tile is written by several, small ones by one.
    """
    columns = assigned.select("idx", "x", "y", "z", "tile_id")
    columns.repartitionByRange("tile_id", "idx").sortWithinPartitions("tile_id").write.partitionBy("tile_id").parquet(path)
