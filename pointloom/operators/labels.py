"""Votes, labels and codes: merging, projecting, mapping and checking them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import grown, unused


def ensemble_mean(votes: DataFrame) -> DataFrame:
    """(idx, class, p) votes -> (idx, class, p, visits): mean over visits."""
    return votes.groupBy("idx", "class").agg(F.avg("p").alias("p"), F.count("*").alias("visits"))


def ensemble_mean_arrays(votes: DataFrame) -> DataFrame:
    """(idx, probs array) votes, one a visit -> (idx, probs): mean by position.

    With a column visits, a vote is the sum of as many. Votes are dealt by idx as
    arrays, one shuffle, and summed where they lie, not as a row a class.
    """
    visits = F.col("visits") if "visits" in votes.columns else F.lit(1)
    dealt = votes.select("idx", "probs", visits.cast("long").alias("visits")).repartition("idx").sortWithinPartitions("idx")
    return dealt.mapInArrow(_means, "idx long, probs array<double>")


def _means(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(idx, probs) of votes (idx, probs, visits) in the order of idx; held are a batch and the votes of its last idx."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if len(table):
            idx = table.column("idx").to_numpy()
            last = int(np.searchsorted(idx, idx[-1]))
            if last:
                yield _mean(table.slice(0, last))
            table = table.slice(last)
        held = table
    if held is not None and len(held):
        yield _mean(held)


def _mean(votes: pa.Table) -> pa.RecordBatch:
    probs = votes.column("probs").combine_chunks()
    widths, values = np.diff(probs.offsets.to_numpy()), probs.flatten().to_numpy()
    points, at = np.unique(votes.column("idx").to_numpy(), return_inverse=True)
    most = int(widths.max())
    place = np.arange(len(values)) - np.repeat(np.cumsum(widths) - widths, widths)
    key, n = np.repeat(at, widths) * most + place, len(points) * most
    visits = np.bincount(key, np.repeat(votes.column("visits").to_numpy(), widths), n)
    there = visits > 0
    means = np.bincount(key, values, n)[there] / visits[there]
    counts = there.reshape(len(points), most).sum(1)
    offsets = np.concatenate([[0], np.cumsum(counts[counts > 0])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(points[counts > 0]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(means))], ["idx", "probs"])


def argmax_label(probs: Column) -> Column:
    """1-based position of the largest value; the first of equals."""
    return F.array_position(probs, F.array_max(probs)).cast("int")


def project(voxels: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Each row of ``voxels`` with the label of its representative."""
    return voxels.join(labels, key)


def merge_labels(points: DataFrame, labels: DataFrame, column: str = "label") -> DataFrame:
    """``points`` with ``column``, the label of its idx, null where none; a column of that name is replaced where it stands.

    Labels have one row an idx at most (``assert_covered`` checks).
    """
    name, key = unused(points, "_merged"), unused(points, "_merged_idx")
    known = labels.select(F.col("idx").alias(key), F.col("label").alias(name))
    return points.join(grown(known), F.col("idx") == F.col(key), "left").withColumn(column, F.col(name)).drop(name, key)


def map_codes(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``labels`` (idx, label) with code, the class's; null if the label is no class of the table.

    ``classes`` (model_id, asprs_code) is a table of at most 256 codes by its range, so it is broadcast.
    """
    table = classes.where(F.col("model_id").between(0, 255)).select(F.col("model_id").alias("label"), F.col("asprs_code").cast("short").alias("code")).dropDuplicates(["label"])
    return labels.join(F.broadcast(table), "label", "left")


def unmapped(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, n): labels that the class table does not have."""
    return map_codes(labels, classes).where("code is null").groupBy("label").agg(F.count("*").alias("n"))


def apply_codes(labels: DataFrame, classes: DataFrame, raw_ids: bool = False) -> DataFrame:
    """(idx, code): the labels' codes, or the labels themselves; one that is unmapped or beyond 0..255 fails the job."""
    mapped = map_codes(labels, classes)
    code = F.col("label").cast("int") if raw_ids else F.col("code").cast("int")
    fine = F.col("code").isNotNull() & code.between(0, 255)
    error = F.raise_error(F.concat(F.lit("unmapped or unfit label "), F.coalesce(F.col("label").cast("string"), F.lit("null")))).cast("short")
    return mapped.select("idx", F.when(fine, code.cast("short")).otherwise(error).alias("code"))


def uncovered(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points without a label."""
    return points.join(labels.select("idx").distinct(), "idx", "left_anti")


def coverage(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n_points, n_uncovered, n_repeated (labelled more than once)."""
    times = labels.groupBy("idx").agg(F.count("*").alias("times"))
    joined = points.select("idx").join(times, "idx", "left")
    return joined.agg(F.count("*").alias("n_points"), F.count_if(F.col("times").isNull()).alias("n_uncovered"), F.count_if(F.col("times") > 1).alias("n_repeated"))


def assert_covered(points: DataFrame, labels: DataFrame) -> None:
    row = coverage(points, labels).first()
    if row["n_uncovered"] or row["n_repeated"]:
        raise ValueError(f"{row['n_uncovered']} points without a label, {row['n_repeated']} with several")


def class_histogram(labels: DataFrame, code: str = "code") -> DataFrame:
    """(code, n) for all codes 0..255, zeros included."""
    counts = labels.groupBy(F.col(code).cast("int").alias("code")).agg(F.count("*").alias("n"))
    codes = labels.sparkSession.range(256).select(F.col("id").cast("int").alias("code"))
    return codes.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def needs_upgrade(labels: DataFrame, point_format: int) -> DataFrame:
    """One row: max_code, and whether it needs the 8-bit class field that formats below 6 lack."""
    most = F.max("code")
    return labels.agg(most.cast("int").alias("max_code"), F.coalesce((most > 31) & F.lit(point_format < 6), F.lit(False)).alias("needs_upgrade"))


def legend(classes: DataFrame) -> DataFrame:
    """(code, color, label): a row for each output code, the first class's colour and the distinct names in the order of ids."""
    firsts = classes.groupBy("asprs_code", "name").agg(F.min("model_id").alias("at"))
    names = firsts.groupBy("asprs_code").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("names"))
    colors = classes.groupBy("asprs_code").agg(F.min_by("color", "model_id").alias("color"))
    return names.join(colors, "asprs_code").select(F.col("asprs_code").alias("code"), "color", F.array_join("names.name", " / ").alias("label")).orderBy("code")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, n, share): for each label of ``a`` how many points, and the part to which ``b`` gives the same; label null for all."""
    joined = a.select("idx", F.col("label").alias("a")).join(b.select("idx", F.col("label").alias("b")), "idx")
    share = F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("share")
    return joined.rollup("a").agg(F.count("*").alias("n"), share).select(F.col("a").alias("label"), "n", "share")


def confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n)."""
    joined = a.select("idx", F.col("label").alias("a")).join(b.select("idx", F.col("label").alias("b")), "idx")
    return joined.groupBy("a", "b").agg(F.count("*").alias("n"))


def compare_class_counts(a: DataFrame, b: DataFrame, code: str = "label") -> DataFrame:
    """(code, n_a, n_b) of codes whose counts differ."""
    left = a.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n_a"))
    right = b.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n_b"))
    both = left.join(right, "code", "full_outer")
    return both.where(~F.col("n_a").eqNullSafe(F.col("n_b"))).select("code", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def compare_clouds(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """One row: same_count, and for each bound whether both clouds agree within ``tolerance``; extra columns of ``a`` that ``b`` lacks."""
    from .points import extent

    left, right = extent(a), extent(b)
    both = left.select([F.col(c).alias(f"a_{c}") for c in left.columns]).crossJoin(F.broadcast(right))
    bounds = [(F.abs(F.col(f"a_{c}") - F.col(c)) <= tolerance).alias(f"same_{c}") for c in left.columns if c != "n"]
    missing = sorted(set(a.columns) - set(b.columns))
    return both.select((F.col("a_n") == F.col("n")).alias("same_count"), *bounds, F.lit(",".join(missing)).alias("lost_columns"))


def assert_same(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``columns`` that only one side has, as often as they are more there; none if attributes were preserved."""
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))


def duplicate_conflicts(points: DataFrame) -> DataFrame:
    """(x, y, z, n_labels) of places whose points have several labels."""
    return points.groupBy("x", "y", "z").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count_distinct("label").alias("n_labels")).where("_lo <> _hi").drop("_lo", "_hi")


def partition_check(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """(idx, n) of points that are in no core, or in several, of ``pieces`` (piece_id, x0, y0, x1, y1)."""
    from .points import in_core
    from .tiling import assign_pieces

    owners = in_core(assign_pieces(points, pieces)).groupBy("idx").agg(F.count("*").alias("n"))
    return points.select("idx").join(owners, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
