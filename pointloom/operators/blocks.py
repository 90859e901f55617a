"""Overlapping blocks: a lattice of boxes that slide by a part of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import grown

AXES = ("x", "y", "z")


def lattice(points: DataFrame, size: tuple[float, ...], overlap: float, origin: tuple[float, ...] | None = None) -> DataFrame:
    """One row: for each axis lo (lower corner), stride and dim (number of blocks, at least one).

    ``origin`` may lie below the points, so that a part of a cloud shares the
    lattice of the whole.
    """
    out = []
    for k, s in enumerate(size):
        c = AXES[k]
        low = F.min(c) if origin is None else F.least(F.min(c), F.lit(float(origin[k])))
        stride = F.lit(s * (1.0 - overlap))
        steps = F.greatest(F.floor((F.max(c) - low - F.lit(float(s))) / stride) + 1, F.lit(0))
        out += [low.alias(f"lo_{c}"), stride.alias(f"stride_{c}"), (steps + 1).cast("long").alias(f"dim_{c}")]
    return points.agg(*out)


def sliding_blocks(points: DataFrame, size: tuple[float, ...], overlap: float = 0.1, origin: tuple[float, ...] | None = None, grid: DataFrame | None = None) -> DataFrame:
    """``points`` once for each block that holds them, with block_id; two axes or three, by the length of ``size``.

    With at most half of a block overlapping, a point can be in the block its
    coordinate falls in and the one before; both are clipped to the lattice,
    and the half-open test decides.
    """
    if overlap > 0.5:
        raise ValueError("blocks may overlap by half at most")
    one = lattice(points, size, overlap, origin) if grid is None else grid
    out, axes = points.crossJoin(F.broadcast(one)), AXES[: len(size)]
    for c, s in zip(axes, size, strict=True):
        at = F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col(f"stride_{c}"))
        inside = lambda i, c=c: F.least(F.greatest(i, F.lit(0)), F.col(f"dim_{c}") - 1)
        out = out.withColumn(f"_i{c}", F.explode(F.array_distinct(F.array(inside(at), inside(at - 1)))))
        low = F.col(f"lo_{c}") + F.col(f"_i{c}") * F.col(f"stride_{c}")
        out = out.where((F.col(c) >= low) & (F.col(c) < low + F.lit(float(s))))
    block = F.col("_ix")
    for c in axes[1:]:
        block = block * F.col(f"dim_{c}") + F.col(f"_i{c}")
    return out.select(*points.columns, block.alias("block_id"))


def block_voxels(members: DataFrame, resolution: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    """``members`` that lie in their block's voxel grid, with vi, vj, vk counted from the members' smallest coordinates."""
    lows = members.groupBy("block_id").agg(*[F.min(c).alias(f"_lo{c}") for c in AXES])
    out = members.join(lows, "block_id")
    for n, c, r in zip(("vi", "vj", "vk"), AXES, resolution, strict=True):
        out = out.withColumn(n, F.floor((F.col(c) - F.col(f"_lo{c}")) / F.lit(float(r))))
    held = F.lit(True)
    for n, s in zip(("vi", "vj", "vk"), shape, strict=True):
        held = held & F.col(n).between(0, s - 1)
    return out.where(held).select(*members.columns, "vi", "vj", "vk")


def with_unseen(votes: DataFrame, points: DataFrame, pred) -> DataFrame:
    """``votes`` and, below all blocks, one of ``pred`` for each of ``points``: a point without votes needs no join to be found."""
    return votes.select("idx", "block_id", "pred").unionByName(points.select("idx", F.lit(-1).cast("long").alias("block_id"), pred.alias("pred")))


def last_block(votes: DataFrame) -> DataFrame:
    """(idx, pred): of a point's overlapping predictions, the one of the highest block."""
    return votes.groupBy("idx").agg(F.max_by("pred", "block_id").alias("pred"))


def or_merge(votes: DataFrame, points: DataFrame | None = None, unseen: bool = True) -> DataFrame:
    """(idx, pred): 2 where any vote (boolean pred) is true, else 1; points without votes count as ``unseen``."""
    merged = votes.groupBy("idx").agg(F.bool_or("pred").alias("_any"))
    if points is not None:
        merged = points.select("idx").join(grown(merged), "idx", "left").withColumn("_any", F.coalesce("_any", F.lit(unseen)))
    return merged.select("idx", (F.col("_any").cast("int") + 1).alias("pred"))


def same_blocks(points: DataFrame, tile: tuple[float, float, float, float], buffer: float, size: tuple[float, ...], overlap: float = 0.1) -> DataFrame:
    """(idx, block_id): where blocks that hold a tile's core points differ between the whole cloud and the tile's window on the cloud's lattice.

    All points of such blocks count, those of the halo too, since a model sees
    them all. None differ if ``buffer`` is at least a block; with less, blocks
    lose points.
    """
    grid = lattice(points, size, overlap)
    x0, y0, x1, y1 = tile
    core = F.expr(f"x >= {x0}D and x < {x1}D and y >= {y0}D and y < {y1}D")

    def held(cloud: DataFrame) -> DataFrame:
        members = sliding_blocks(cloud, size, overlap, grid=grid)
        return members.join(members.where(core).select("block_id").distinct(), "block_id", "left_semi").select("idx", "block_id")

    window = points.where(F.col("x").between(x0 - buffer, x1 + buffer) & F.col("y").between(y0 - buffer, y1 + buffer))
    whole, part = held(points), held(window)
    return whole.exceptAll(part).unionByName(part.exceptAll(whole))
