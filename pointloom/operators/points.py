"""Projections, voxels and representatives of point clouds (idx, x, y, z, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import grown, numbered

AXES = ("x", "y", "z")
#: Beyond this a 64-bit key may wrap.
LIMIT = float(1 << 62)


def extent(points: DataFrame) -> DataFrame:
    """One row: smallest and largest value of each axis, and n."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def is_finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_counts(points: DataFrame) -> DataFrame:
    """One row: n, and n_bad with a coordinate that is no finite number."""
    fine = is_finite("x") & is_finite("y") & is_finite("z")
    return points.agg(F.count("*").alias("n"), F.count_if(~fine).alias("n_bad"))


def assert_finite(points: DataFrame) -> DataFrame:
    """``points``; an unusable coordinate fails the job that meets it."""
    bad = F.raise_error(F.lit("coordinates contain NaN, null or infinite values")).cast("double")
    return points.withColumns({c: F.when(is_finite(c), F.col(c)).otherwise(bad) for c in AXES})


def origin_of(points: DataFrame) -> DataFrame:
    """One row: ox, oy, oz, the whole metres below the smallest coordinates."""
    return points.agg(*[F.floor(F.min(c)).cast("double").alias(f"o{c}") for c in AXES])


def localize(points: DataFrame, origin: DataFrame | tuple[float, float, float] | None = None) -> DataFrame:
    """Adds lx, ly, lz: float32 metres from ``origin`` (one row, or three numbers); by default the cloud's own."""
    if isinstance(origin, tuple):
        shifted, drop = points.withColumns({f"o{c}": F.lit(float(o)) for c, o in zip(AXES, origin, strict=True)}), []
    else:
        shifted, drop = points.crossJoin(F.broadcast(origin_of(points) if origin is None else origin)), []  # one row
    return shifted.withColumns({f"l{c}": (F.col(c) - F.col(f"o{c}")).cast("float") for c in AXES}).drop("ox", "oy", "oz", *drop)


def voxelize(local: DataFrame, grid: float) -> DataFrame:
    """Adds vx, vy, vz: floor of the float32 local coordinates, widened, over ``grid``."""
    out = {}
    for c in AXES:
        cell = F.floor(F.col(f"l{c}").cast("double") / F.lit(float(grid)))
        ratio = F.col(f"l{c}").cast("double") / F.lit(float(grid))
        out[f"v{c}"] = F.when(F.abs(ratio) < LIMIT, cell).otherwise(F.raise_error(F.lit("extent too large for a 64-bit voxel key at this grid")).cast("long"))
    return local.withColumns(out)


def voxel_key(voxels: DataFrame) -> DataFrame:
    """Adds key = (cx * sy + cy) * sz + cz, from cells counted from the smallest and the spans of the axes."""
    lows = voxels.agg(*[F.min(f"v{c}").alias(f"_lo{c}") for c in AXES], *[(F.max(f"v{c}") - F.min(f"v{c}") + 1).alias(f"_span{c}") for c in AXES])
    fits = F.col("_spanx").cast("double") * F.col("_spany") * F.col("_spanz") < LIMIT
    cx, cy, cz = (F.col(f"v{c}") - F.col(f"_lo{c}") for c in AXES)
    key = (cx * F.col("_spany") + cy) * F.col("_spanz") + cz
    return voxels.crossJoin(F.broadcast(lows)).withColumn("key", F.when(fits, key).otherwise(F.raise_error(F.lit("extent too large for a 64-bit voxel key")).cast("long"))).drop(*lows.columns)


def grid_coord(points: DataFrame, size: float, stride: int = 1) -> DataFrame:
    """Adds gx, gy, gz: (coordinate - smallest) / size, cut to whole numbers, then divided by ``stride``."""
    lows = points.agg(*[F.min(c).alias(f"_m{c}") for c in AXES])
    out = {f"g{c}": F.expr(f"cast((double({c}) - _m{c}) / {float(size)}D as long) div {stride}") for c in AXES}
    return points.crossJoin(F.broadcast(lows)).withColumns(out).drop(*lows.columns)


def in_window(points: DataFrame, rect: tuple[float, float, float, float]) -> DataFrame:
    """Points of the closed rectangle (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = rect
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def in_core(df: DataFrame) -> DataFrame:
    """Rows whose x, y lie in their own half-open x0 <= x < x1, y0 <= y < y1."""
    return df.where("x >= x0 and x < x1 and y >= y0 and y < y1")


def normalize_group(df: DataFrame, group: str) -> DataFrame:
    """Adds nx, ny, height: float32 coordinates less the group's mean, height above its lowest point; and bias 1.

    Means are aggregated and joined, so a large group spreads over tasks.
    """
    single = df.withColumns({f"_f{c}": F.col(c).cast("float") for c in AXES})
    means = single.groupBy(F.col(group).alias("_group")).agg(*[F.avg(f"_f{c}").cast("float").alias(f"_mean{c}") for c in AXES], F.min("_fz").alias("_low"))
    joined = single.join(means, F.col(group) == F.col("_group"))
    return joined.select(
        *df.columns,
        (F.col("_fx") - F.col("_meanx")).alias("nx"),
        (F.col("_fy") - F.col("_meany")).alias("ny"),
        ((F.col("_fz") - F.col("_meanz")) - (F.col("_low") - F.col("_meanz"))).alias("height"),
        F.lit(1.0).cast("float").alias("bias"),
    )


VOXEL = ["vx", "vy", "vz"]


def voxel_downsample(points: DataFrame, grid: float, origin=None) -> DataFrame:
    """The first point (smallest idx) of each occupied voxel, with n points of the voxel."""
    voxels = voxelize(localize(points, origin), grid)
    # a column at a time: buffers of fixed width are aggregated by hash, a struct would be sorted
    firsts = [F.min_by(c, "idx").alias(c) for c in points.columns]
    return voxels.groupBy(*VOXEL).agg(*firsts, F.count("*").alias("n"))


def occupied_voxels(points: DataFrame, grid: float, origin=None) -> DataFrame:
    """(vx, vy, vz, rep_idx, n) of each occupied voxel."""
    return voxelize(localize(points, origin), grid).groupBy(*VOXEL).agg(F.min("idx").alias("rep_idx"), F.count("*").alias("n"))


def voxel_projection(points: DataFrame, grid: float, origin=None) -> DataFrame:
    """(idx, rep_idx, rep_number): representatives numbered from 0 in cloud order, for every point."""
    voxels = voxelize(localize(points, origin), grid)
    reps = voxels.groupBy(*VOXEL).agg(F.min("idx").alias("rep_idx"))
    reps = numbered(reps, [F.expr("rep_idx div 65536")], [F.col("rep_idx")], "rep_number")
    return voxels.join(grown(reps), VOXEL).select("idx", "rep_idx", "rep_number")


def with_representatives(points: DataFrame, grid: float, origin=None) -> DataFrame:
    """``points`` with rep_idx, the first point of each one's voxel."""
    # led by a hash, since a sort by an axis of few values compares whole rows
    voxels = voxelize(localize(points, origin), grid).withColumn("_voxel", F.xxhash64(*VOXEL))
    reps = voxels.groupBy("_voxel", *VOXEL).agg(F.min("idx").alias("rep_idx"))
    return voxels.join(grown(reps), ["_voxel", *VOXEL]).select(*points.columns, "rep_idx")


def crop_centers(points: DataFrame, spacing: float, origin=None) -> DataFrame:
    """idx of the first point of each occupied cell of side ``spacing``."""
    return occupied_voxels(points, spacing, origin).select(F.col("rep_idx").alias("idx"))
