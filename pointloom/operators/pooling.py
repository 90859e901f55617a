"""Multi-resolution pooling, curve order and ragged groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import batch_code, curve_code
from ..session import numbered, ranked, running_total

REDUCERS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def segment_reduce(df: DataFrame, key: str, values: list[str], how: str) -> DataFrame:
    """(key, values...) reduced by ``how``: sum, mean, min or max."""
    return df.groupBy(key).agg(*[REDUCERS[how](v).alias(v) for v in values])


def grid_pool(df: DataFrame, stride: int, values: list[str], how: str = "max") -> DataFrame:
    """Cells of ``stride`` grid steps: (cluster, batch, px, py, pz, x, y, z, values..., n, head, mask).

    Input: idx, batch, gx, gy, gz, x, y, z, ``values`` and optionally mask
    (boolean; kept where over half are true). Clusters count from 0 by batch
    and cell; head is the smallest idx.
    """
    cells = [F.expr(f"g{c} div {stride}").alias(f"p{c}") for c in "xyz"]
    extra = [(F.avg(F.col("mask").cast("double")) > 0.5).alias("mask")] if "mask" in df.columns else []
    pooled = df.groupBy("batch", *cells).agg(
        *[F.avg(c).alias(c) for c in "xyz"], *[REDUCERS[how](v).alias(v) for v in values], F.count("*").alias("n"), F.min("idx").alias("head"), *extra
    )
    return numbered(pooled, [F.col("batch"), F.col("px")], [F.col("py"), F.col("pz")], "cluster")


def pooling_inverse(df: DataFrame, pooled: DataFrame, stride: int) -> DataFrame:
    """(idx, cluster) of every point."""
    cells = df.select("idx", "batch", *[F.expr(f"g{c} div {stride}").alias(f"p{c}") for c in "xyz"])
    return cells.join(pooled.select("batch", "px", "py", "pz", "cluster"), ["batch", "px", "py", "pz"]).select("idx", "cluster")


def unpool(parent: DataFrame, inverse: DataFrame, pooled: DataFrame, value: str) -> DataFrame:
    """(idx, value): the pooled value carried back to every point, plus the point's own."""
    coarse = inverse.join(pooled.select("cluster", F.col(value).alias("_coarse")), "cluster")
    return parent.join(coarse, "idx").select("idx", (F.col(value) + F.col("_coarse")).alias(value))


def group_offsets(df: DataFrame, key: str = "batch") -> DataFrame:
    """(key, n, offset): group sizes and their running sum, groups in order."""
    return running_total(df.groupBy(key).agg(F.count("*").alias("n")), [key], "n", "offset")


#: Members of a group that one row stands for on the way to a row each.
STRETCH = 100_000


def expand_offsets(offsets: DataFrame, key: str = "batch") -> DataFrame:
    """(position, key): the inverse, a row for each member. Groups are cut into stretches, which are dealt anew, so no group is expanded by one task."""
    first, last = F.col("offset") - F.col("n"), F.col("offset") - 1
    cut = offsets.where("n > 0").select(key, last.alias("_last"), F.explode(F.sequence(first, last, F.lit(STRETCH).cast("long"))).alias("_first"))
    dealt = cut.repartition(key, "_first")
    return dealt.select(F.explode(F.sequence("_first", F.least(F.col("_first") + STRETCH - 1, F.col("_last")))).alias("position"), key)


def serialize(df: DataFrame, order: str = "z", depth: int = 16, parts: int | None = None, cubes: bool = False) -> DataFrame:
    """Adds code (of batch, gx, gy, gz along the curve) and rank, its place from 0 in the order of all codes, ties by idx.

    Codes are dealt by ``parts`` ranges (as many as shuffles have by default)
    with bounds sampled from the codes, so a cloud in a corner of the curve
    is dealt as evenly as any other. With ``cubes`` cells beyond 2**depth a side
    are coded in cubes of their own (``curves.zorder_encode``).
    """
    coded = df.withColumn("code", batch_code(F.col("batch"), curve_code(order, F.col("gx"), F.col("gy"), F.col("gz"), depth, cubes), depth))
    return ranked(coded, ["code", "idx"], "rank", parts)


def patches(df: DataFrame, size: int, depth_key: str = "batch") -> DataFrame:
    """(batch, patch, slot, idx, borrowed): each batch's ranks cut into patches of ``size``.

    A batch larger than one patch is padded to whole patches: slots that the
    last one lacks repeat those of the patch before (borrowed true).
    """
    sizes = df.groupBy(depth_key).agg(F.min("rank").alias("_first"), F.count("*").alias("_n"))
    placed = df.join(sizes, depth_key).withColumn("_at", F.col("rank") - F.col("_first"))
    patch = F.expr(f"_at div {size}")
    slot = F.expr(f"_at % {size}")
    own = placed.select(depth_key, patch.alias("patch"), slot.alias("slot"), "idx", F.lit(False).alias("borrowed"))
    last = F.expr(f"_n div {size}")
    lent = placed.where((F.col("_n") > size) & (F.expr(f"_n % {size}") != 0) & (patch == last - 1) & (slot >= F.expr(f"_n % {size}")))
    return own.unionByName(lent.select(depth_key, last.alias("patch"), slot.alias("slot"), "idx", F.lit(True).alias("borrowed")))
