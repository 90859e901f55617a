"""Neighbours within a radius, by cells of that size and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, few, grown
from .points import VOXEL, crop_centers, localize, voxelize

AXES = ("x", "y", "z")


#: How often the radius may be halved where points are dense.
HALVINGS = 9


def _cells(side) -> list:
    return [F.floor(F.col(c) / side).cast("long").alias(f"_{c}") for c in AXES]


CELL = ["_level", "_x", "_y", "_z"]


def _reach(radius: float, level):
    """How far to look at a level: the diagonal of its cell, at most the radius."""
    return F.least(F.lit(float(radius)), F.lit(math.sqrt(3) * radius * (1 + 1e-9)) / F.pow(F.lit(2.0), level))


def _fine(radius: float) -> list:
    """Columns of the cell at the deepest level."""
    return _cells(F.lit(radius / 2**HALVINGS))


def _cell_at(level) -> list:
    """The cell at a level that a cell of the deepest level lies in."""
    return [F.shiftright(F.col(f"_{c}"), HALVINGS - level).alias(f"_{c}") if isinstance(level, int) else F.expr(f"shiftright(_{c}, {HALVINGS} - {level})").alias(f"_{c}") for c in AXES]


def dense_cells(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(_level, _x, _y, _z): cells of radius / 2 ** _level that hold at least ``k`` points, for levels from 1 up.

    The index of a cloud: it is stored and serves any number of searches.
    Counted from the coarsest level down, each level only inside the dense
    cells of the one above, until none is dense, so an even cloud is read
    once or twice, and what is stored are the dense cells alone.
    """
    inside, found = points.select(*_fine(radius)), None
    for level in range(1, HALVINGS + 1):
        counts = inside.select(*_cell_at(level)).groupBy(*CELL[1:]).agg(F.count("*").alias("_n"))
        dense = checkpointed(counts.where(F.col("_n") >= k).select(F.lit(level).alias("_level"), *CELL[1:]))
        found = dense if found is None else found.unionByName(dense)
        if dense.isEmpty():
            return found
        keys = dense.select(*[F.col(c).alias(f"_in{c}") for c in CELL[1:]])
        fine = points.select(*_fine(radius))
        inside = fine.join(grown(keys), [cell == F.col(f"_in{c}") for cell, c in zip(_cell_at(level), CELL[1:], strict=True)], "left_semi")
    return found


def levels_of(centers: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """``centers`` (center, x, y, z) with _level: the deepest level at which the cell around the centre is one of ``cells`` (``dense_cells``).

    ``k`` points lie within that cell's diagonal, so no nearer neighbour is
    further away. Level 0, the radius itself, where no cell has as many.
    """
    level = F.explode(F.sequence(F.lit(1), F.lit(HALVINGS))).alias("_level")
    around = centers.select("center", *_fine(radius), level).select("center", "_level", *_cell_at("_level"))
    dense = around.join(grown(cells), CELL, "left_semi").groupBy("center").agg(F.max("_level").alias("_level"))
    return centers.join(grown(dense), "center", "left").select("center", *AXES, F.coalesce("_level", F.lit(0)).alias("_level"))


#: Where a crop's point and its centre lie.
PLACED = (*AXES, "cx", "cy")

#: Centres up to which their surroundings, at most 27 rows each, are broadcast; more meet the points by shuffle.
BROADCAST_CENTERS = 8_000

#: ``k`` up to which searches use cells of twice the radius where points are not dense: the copies of centres, 8 and not 27, cost more there than the points compared.
FEW_NEIGHBORS = 64

#: By how much the cells looked at reach beyond the radius, so that no rounding of a coordinate loses a point.
SLACK = 1 + 1e-6


def _side(radius: float, wide: bool):
    """The side of a cell at a level: the reach, or twice as much where no cell is dense if ``wide``."""
    reach = _reach(radius, F.col("_level")) * SLACK
    return F.when(F.col("_level") == 0, 2 * reach).otherwise(reach) if wide else reach


#: A level and cell as one number, which sorts faster than four. Cells that are 2 ** 20 apart on an axis share it; no two around a
#: centre do, and their points are too far to be kept.
CELL_KEY = "shiftleft(cast(_level AS bigint), 60) | shiftleft(_x & 1048575, 40) | shiftleft(_y & 1048575, 20) | (_z & 1048575)"


def surroundings(centers: DataFrame, radius: float, wide: bool) -> DataFrame:
    """(center, _level, cx, cy, cz, _x, _y, _z): each center (center, x, y, z, _level) in every cell that points it may reach lie in."""
    reach, side = _reach(radius, F.col("_level")) * SLACK, _side(radius, wide)
    found = centers.select("center", "_level", *[F.col(c).alias(f"c{c}") for c in AXES])
    for c in AXES:
        ends = [F.floor((F.col(f"c{c}") + sign * reach) / side).cast("long") for sign in (-1, 1)]
        found = found.withColumn(f"_{c}", F.explode(F.sequence(*ends)))
    return found


def within_radius(points: DataFrame, centers: DataFrame, radius: float, placed_too: bool = False, wide: bool = False) -> DataFrame:
    """(center, idx, d2): points at most ``radius`` from each center (center, x, y, z, and optionally _level of ``levels_of``).

    With ``placed_too`` also PLACED, so that nothing is joined again for it. Centres go to the cells around them (``surroundings``), points to
    their own, so only neighbours in space meet; at higher levels cells and reach are smaller.
    """
    placed = centers if "_level" in centers.columns else centers.withColumn("_level", F.lit(0))
    sizes = {r["_level"]: r["count"] for r in placed.groupBy("_level").count().collect()} or {0: 0} if "_level" in centers.columns else {0: centers.count()}  # at most HALVINGS + 1
    reach = _reach(radius, F.col("_level"))
    placed = surroundings(placed, radius, wide).withColumn("_cell", F.expr(CELL_KEY)).drop(*CELL)
    placed = F.broadcast(placed) if sum(sizes.values()) <= BROADCAST_CENTERS else grown(placed)
    cloud = points.select("idx", *AXES)
    leveled = cloud.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(sizes))))) if len(sizes) > 1 else cloud.withColumn("_level", F.lit(min(sizes)))
    own = leveled.select("idx", *AXES, "_level", *_cells(_side(radius, wide))).withColumn("_cell", F.expr(CELL_KEY))
    d2 = F.expr("(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)")
    kept = ["center", "idx", *PLACED * placed_too]
    met = own.join(placed, "_cell").select(*kept, "_level", d2.alias("d2"))
    return met.where(F.col("d2") <= F.when(F.col("_level") == 0, F.lit(float(radius) * float(radius))).otherwise(reach * reach)).select(*kept, "d2")


def thinned(points: DataFrame, cells: DataFrame, k: int, radius: float) -> DataFrame:
    """(idx, x, y, z) of ``points``, of each place only the ``k`` smallest idx.

    A place with more lies in a dense cell of the deepest level; only points
    of such cells are numbered, and nothing where there is none.
    """
    cloud, crowded = points.select("idx", *AXES), cells.where(F.col("_level") == HALVINGS).select(*[F.col(c).alias(f"_in{c}") for c in CELL[1:]])
    if crowded.isEmpty():
        return cloud
    inside = [cell == F.col(f"_in{c}") for cell, c in zip(_fine(radius), CELL[1:], strict=True)]
    place = Window.partitionBy(*AXES).orderBy("idx")
    first = cloud.join(grown(crowded), inside, "left_semi").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")
    return cloud.join(grown(crowded), inside, "left_anti").unionByName(first)


def nearest(found: DataFrame, k: int, own_first: bool = False) -> DataFrame:
    """The ``k`` nearest of each center, ties by idx (``own_first``: the centre before all others), with rank from 1."""
    order = Window.partitionBy("center").orderBy(*[F.col("idx") != F.col("center")] * own_first, "d2", "idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_crops(points: DataFrame, centers: DataFrame, k: int, radius: float, own_first: bool = False, cells: DataFrame | None = None, single: bool = False, placed_too: bool = False, ranks: bool = True) -> DataFrame:
    """(center, idx, d2, rank): at most ``k`` nearest points within ``radius`` of each center.

    ``centers`` has idx of points, and may have their x, y, z. A centre is its own first neighbour with
    ``own_first``; else points in the same place with smaller idx precede it.
    Where points are dense the search looks only as far as ``k`` points
    surely lie, and of a place only the ``k`` smallest idx can be among the
    nearest, so pairs grow with ``k``, not with the density. ``cells``: the
    cloud's ``dense_cells``, if they are known; ``single``: no two points
    share a place; ``placed_too``: with PLACED. The cloud itself is neither
    sorted nor stored. Without ``ranks`` nothing is cut: for searches that
    ``most_around`` tells to find at most ``k``.
    """
    cells = dense_cells(points, k, radius) if cells is None else cells
    known = centers if {*AXES} <= {*centers.columns} else points.join(grown(centers.select("idx")), "idx", "left_semi")
    at = checkpointed(known.select(F.col("idx").alias("center"), *AXES))
    some = points.select("idx", *AXES) if single else thinned(points, cells, k, radius)
    found = within_radius(some, at if cells.isEmpty() else checkpointed(levels_of(at, cells, radius)), radius, placed_too, k <= FEW_NEIGHBORS)
    if own_first:
        own = at.select("center", F.col("center").alias("idx"), *AXES, F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(0.0).alias("d2"))
        found = found.where("idx <> center").unionByName(own.select(*found.columns))
    return nearest(found, k, own_first) if ranks else found


def fill_centers(left: DataFrame, k: int, size: float, turn: int) -> DataFrame:
    """(idx, x, y, z) of the first point of each cell of side ``size``, and of one in ``k`` points of cells with more than ``k``.

    The latter go by a hash that changes with ``turn``, so no window holds a dense cell.
    """
    voxels = voxelize(localize(left), size).select("idx", *AXES, *VOXEL)
    firsts = checkpointed(voxels.groupBy(*VOXEL).agg(F.min("idx").alias("first"), *[F.min_by(c, "idx").alias(c) for c in AXES], F.count("*").alias("n")))
    found, crowded = firsts.select(F.col("first").alias("idx"), *AXES), firsts.where(F.col("n") > k).select(*VOXEL)
    if crowded.isEmpty():
        return found
    some = voxels.where(F.pmod(F.xxhash64("idx", F.lit(turn)), F.lit(k)) == 0).join(grown(crowded), VOXEL, "left_semi")
    return found.union(some.select("idx", *AXES)).distinct()


def most_around(points: DataFrame, radius: float) -> int:
    """A number that no search within ``radius`` exceeds: 27 times the points of the fullest cell of that side."""
    return 27 * (points.groupBy(*_cells(F.lit(float(radius)))).count().agg(F.max("count")).first()[0] or 0)


def cover_all(points: DataFrame, k: int, radius: float, spacing: float) -> DataFrame:
    """(center, idx, d2, rank): crops that together visit every point (``placed_crops``)."""
    return _crops(points, k, radius, spacing, False).select("center", "idx", "d2", "rank")


def placed_crops(points: DataFrame, k: int, radius: float, spacing: float) -> DataFrame:
    """(center, idx, x, y, z, cx, cy): crops that together visit every point.

    The first round puts a crop at the first point of each cell of side
    ``spacing``; each further round does so, in cells of side
    radius / sqrt(3), for points that no crop has, with more crops in dense
    cells, until no point is left. Points in one place go as one, the first of
    them, so ``k`` counts places; the others of a place are added once, with
    the d2 and rank of the first, to the crop that has it nearest. A centre is
    its own first neighbour, so a round visits at least its own centres and
    the rounds end; the points left are joined away in the cluster, and the
    driver only asks whether there are any. Rounds share one index of dense
    cells and read the stored places; none writes the cloud again. Where no
    search can find more than ``k``, crops are not sorted to be cut.
    """
    return _crops(points, k, radius, spacing, True).select("center", "idx", *PLACED)


def _crops(points: DataFrame, k: int, radius: float, spacing: float, placed_too: bool) -> DataFrame:
    places = checkpointed(points.groupBy(*AXES).agg(F.min("idx").alias("idx"), F.count("*").alias("_n")))
    single = places.drop("_n")
    cells, ranks = dense_cells(single, k, radius), not placed_too or most_around(single, radius) > k
    crops = checkpointed(knn_crops(single, crop_centers(single, spacing), k, radius, True, cells, True, placed_too, ranks))
    left = checkpointed(single.join(grown(crops.select("idx").distinct()), "idx", "left_anti"))
    turn = 0
    while not left.isEmpty():
        more = checkpointed(knn_crops(single, fill_centers(left, k, radius / math.sqrt(3), turn), k, radius, True, cells, True, placed_too, ranks))
        crops = crops.unionByName(more)
        left = checkpointed(left.join(grown(more.select("idx")), "idx", "left_anti"))  # a point is in few of these crops
        turn += 1
    several = places.where("_n > 1").select(F.col("idx").alias("_first"), *[F.col(c).alias(f"_{c}") for c in AXES])
    others = checkpointed(points.select("idx", *AXES).join(few(several), [F.col(c) == F.col(f"_{c}") for c in AXES]).where("idx <> _first").select("idx", "_first"))
    if others.isEmpty():
        return crops
    shared = crops.join(grown(others.select(F.col("_first").alias("idx")).distinct()), "idx", "left_semi")
    kept = [c for c in crops.columns if c not in ("center", "idx", "d2")]
    near = shared.groupBy(F.col("idx").alias("_first")).agg(F.min(F.struct("d2", "center", *kept)).alias("_crop"))
    added = others.join(grown(near), "_first").select("_crop.center", "idx", "_crop.d2", *[f"_crop.{c}" for c in kept])
    return crops.unionByName(added)
