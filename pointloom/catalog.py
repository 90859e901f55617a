"""Queries over the driver's tables for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codes, curves, units
from .operators import blocks, labels, neighbors, points, pooling, tiling
from .plans import labelling
from .session import checkpointed, few, grown, qualified, scratch
from .sources import files as catalogue
from .sources import las, publishing, views
from .streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WITH = {"pts": views.PTS, "big": views.PTS_BIG, "vecs": views.VECS.format(1, 2, 3), "files": views.FILES, "classes": views.CLASSES, "own": views.OWN_CLASSES}


def query(sql: str | None = None, *ctes: str):
    """Registers a function as the query of its name; ``ctes`` are the views and texts that ``sql`` builds on."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            parts = [f"{c} AS ({WITH[c]})" if c in WITH else c for c in ctes]
            SQL[run.__name__] = (f"WITH {', '.join(parts)}\n" if parts else "") + sql
        return run

    return register


# --- points and voxels ---------------------------------------------------------


@query("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM pts", "pts")
def extent(spark, sf):
    return points.extent(views.pts(spark, sf))


@query("SELECT count(*) AS n, count(*) FILTER (model_id = 1 OR model_id = 2 AND idx % 3 = 0 OR model_id = 3 AND idx % 2 = 0) AS n_bad FROM pts", "pts")
def finite_check(spark, sf):
    """Some x are NaN, some y infinite, some z null."""
    bad = {"x": "if(model_id = 1, double('NaN'), x)", "y": "if(model_id = 2 and idx % 3 = 0, double('-Infinity'), y)", "z": "if(model_id = 3 and idx % 2 = 0, null, z)"}
    return points.finite_counts(views.pts(spark, sf).withColumns({c: F.expr(e) for c, e in bad.items()}))


LOCAL = "loc AS (SELECT idx, x, y, z, model_id, cast(x - ox AS REAL) AS lx, cast(y - oy AS REAL) AS ly, cast(z - oz AS REAL) AS lz FROM pts, (SELECT floor(min(x)) AS ox, floor(min(y)) AS oy, floor(min(z)) AS oz FROM pts))"


def _vox(grid: float) -> str:
    return f"vox AS (SELECT *, cast(floor(cast(lx AS DOUBLE) / cast({grid} AS DOUBLE)) AS BIGINT) AS vx, cast(floor(cast(ly AS DOUBLE) / cast({grid} AS DOUBLE)) AS BIGINT) AS vy, cast(floor(cast(lz AS DOUBLE) / cast({grid} AS DOUBLE)) AS BIGINT) AS vz FROM loc)"


@query("SELECT idx, lx, ly, lz FROM loc", "pts", LOCAL)
def localize_f32(spark, sf):
    return points.localize(views.pts(spark, sf)).select("idx", "lx", "ly", "lz")


@query("SELECT idx, vx, vy, vz FROM vox", "pts", LOCAL, _vox(0.1))
def voxel_index(spark, sf):
    return points.voxelize(points.localize(views.pts(spark, sf)), 0.1).select("idx", "vx", "vy", "vz")


SPANS = "spans AS (SELECT min(vx) AS ax, min(vy) AS ay, min(vz) AS az, max(vy) - min(vy) + 1 AS sy, max(vz) - min(vz) + 1 AS sz FROM vox)"


@query("SELECT idx, ((vx - ax) * sy + (vy - ay)) * sz + (vz - az) AS key FROM vox, spans", "pts", LOCAL, _vox(0.5), SPANS)
def voxel_key(spark, sf):
    return points.voxel_key(points.voxelize(points.localize(views.pts(spark, sf)), 0.5)).select("idx", "key")


@query("SELECT idx, cast(trunc((x - a) / 0.5) AS BIGINT) // 4 AS gx, cast(trunc((y - b) / 0.5) AS BIGINT) // 4 AS gy, cast(trunc((z - c) / 0.5) AS BIGINT) // 4 AS gz FROM pts, (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM pts)", "pts")
def grid_coord(spark, sf):
    return points.grid_coord(views.pts(spark, sf), 0.5, 4).select("idx", "gx", "gy", "gz")


@query("SELECT idx, x, y FROM pts WHERE x BETWEEN 50 AND 100 AND y BETWEEN 10 AND 60", "pts")
def window_filter(spark, sf):
    return points.in_window(views.pts(spark, sf), (50.0, 10.0, 100.0, 60.0)).select("idx", "x", "y")


@query("SELECT vx, vy, vz, arg_min(idx, idx) AS idx, arg_min(x, idx) AS x, arg_min(model_id, idx) AS model_id, count(*) AS n FROM vox GROUP BY ALL", "pts", LOCAL, _vox(5))
def voxel_downsample(spark, sf):
    return points.voxel_downsample(views.pts(spark, sf), 5.0).select("vx", "vy", "vz", "idx", "x", "model_id", "n")


@query("SELECT count(*) AS n_voxels, sum(n)::BIGINT AS n_points, max(n) AS fullest FROM (SELECT count(*) AS n FROM vox GROUP BY vx, vy, vz)", "pts", LOCAL, _vox(5))
def occupied_voxels(spark, sf):
    return points.occupied_voxels(views.pts(spark, sf), 5.0).agg(F.count("*").alias("n_voxels"), F.sum("n").alias("n_points"), F.max("n").alias("fullest"))


@query("SELECT v.idx, r.rep_idx, r.rep_number FROM vox v JOIN (SELECT vx, vy, vz, min(idx) AS rep_idx, row_number() OVER (ORDER BY min(idx)) - 1 AS rep_number FROM vox GROUP BY vx, vy, vz) r USING (vx, vy, vz)", "pts", LOCAL, _vox(5))
def voxel_projection(spark, sf):
    return points.voxel_projection(views.pts(spark, sf), 5.0)


@query("SELECT min(idx) AS idx FROM vox GROUP BY vx, vy, vz", "pts", LOCAL, _vox(40))
def crop_centers(spark, sf):
    return points.crop_centers(views.pts(spark, sf), 40.0)


# --- tiles ----------------------------------------------------------------------

#: 50 m tiles from the cloud's corner; ends moved out as in the grid.
TILES = """tiles AS (
    SELECT iy * nx + ix AS tile_id, ix, iy, x_lo + ix * 50 AS x0, CASE WHEN ix = nx - 1 THEN x_hi + greatest(1e-6, (x_hi - x_lo) * 1e-9) ELSE x_lo + (ix + 1) * 50 END AS x1,
           y_lo + iy * 50 AS y0, CASE WHEN iy = ny - 1 THEN y_hi + greatest(1e-6, (y_hi - y_lo) * 1e-9) ELSE y_lo + (iy + 1) * 50 END AS y1
    FROM (SELECT *, cast(ceil((x_hi - x_lo) / 50) AS BIGINT) AS nx, cast(ceil((y_hi - y_lo) / 50) AS BIGINT) AS ny
          FROM (SELECT 0.0::DOUBLE AS x_lo, greatest(max(x), 1.0) AS x_hi, 0.0::DOUBLE AS y_lo, greatest(max(y), 1.0) AS y_hi FROM pts)) e,
         generate_series(0, 4000) a(ix), generate_series(0, 4000) b(iy)
    WHERE ix < nx AND iy < ny)"""
PAIRS = "pairs AS (SELECT p.*, t.* FROM pts p JOIN tiles t ON p.x BETWEEN t.x0 - 10 AND t.x1 + 10 AND p.y BETWEEN t.y0 - 10 AND t.y1 + 10)"
HALO = 10.0


def _grid(cloud: DataFrame) -> tiling.TileGrid:
    """50 m tiles from (0, 0) to the cloud's far corner."""
    rect, n = tiling.plane_extent(cloud)
    return tiling.grid_over((0.0, 0.0, rect[2], rect[3]), n, size=50.0)


@query("SELECT idx, tile_id FROM pairs", "pts", TILES, PAIRS)
def tile_assign(spark, sf):
    cloud = views.pts(spark, sf)
    return tiling.assign_tiles(cloud, _grid(cloud), HALO).select("idx", "tile_id")


COUNTS = "counts AS (SELECT tile_id, count(*) AS n_window, count(*) FILTER (x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS n_core FROM pairs GROUP BY tile_id)"


def _counts(spark, sf) -> DataFrame:
    cloud = views.pts(spark, sf)
    return tiling.tile_counts(tiling.assign_tiles(cloud.select("idx", "x", "y"), _grid(cloud), HALO))


@query("SELECT * FROM counts", "pts", TILES, PAIRS, COUNTS)
def tile_counts(spark, sf):
    return _counts(spark, sf)


@query("SELECT tile_id, count(*) AS n_core FROM pairs WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY tile_id", "pts", TILES, PAIRS)
def core_counts(spark, sf):
    cloud = views.pts(spark, sf)
    return points.in_core(tiling.assign_tiles(cloud, _grid(cloud), HALO)).groupBy("tile_id").agg(F.count("*").alias("n_core"))


@query("SELECT sum(n_window)::BIGINT AS window_points, sum(n_core)::BIGINT AS core_points, round(sum(n_window) / sum(n_core), 6) AS copies, (sum(n_window) * 32)::BIGINT AS bytes FROM counts", "pts", TILES, PAIRS, COUNTS)
def halo_share(spark, sf):
    return tiling.replication_report(_counts(spark, sf))


@query("SELECT count(*) AS n_tiles, coalesce(max(n_window), 0) AS most, coalesce(max(n_window), 0) * 32 AS needed_bytes FROM counts WHERE n_window > 1000", "pts", TILES, PAIRS, COUNTS)
def over_budget(spark, sf):
    return tiling.over_budget(_counts(spark, sf), 1000)


@query("SELECT * FROM counts ORDER BY n_window DESC, tile_id LIMIT 5", "pts", TILES, PAIRS, COUNTS)
def largest_tiles(spark, sf):
    return tiling.largest_tiles(_counts(spark, sf), 5)


@query("SELECT count(*) AS n_tiles, max(n_window) AS most, round(avg(n_window), 4) AS mean, sum(n_core)::BIGINT AS points FROM counts", "pts", TILES, PAIRS, COUNTS)
def tiling_summary(spark, sf):
    return tiling.tiling_summary(_counts(spark, sf))


@query("SELECT DISTINCT idx FROM pts WHERE x < 60 OR x >= 40", "pts")
def union_distinct(spark, sf):
    """Two overlapping windows together, each point once."""
    cloud = views.pts(spark, sf)
    return cloud.where("x < 60").select("idx").unionByName(cloud.where("x >= 40").select("idx")).distinct()


@query("SELECT tile_id, ix, iy, x0, y0, x1, y1 FROM tiles", "pts", TILES)
def tile_grid(spark, sf):
    return _grid(views.pts(spark, sf)).tiles(spark)


@query("SELECT count(*) AS n_points, 0::BIGINT AS n_wrong FROM pts", "pts")
def tile_partition(spark, sf):
    """Automatic tiles of about 2,000 points: every point lies in exactly one core."""
    cloud = views.pts(spark, sf).select("idx", "x", "y")
    owners = points.in_core(tiling.assign_tiles(cloud, tiling.tile_grid(cloud, 2000))).groupBy("idx").agg(F.count("*").alias("n"))
    joined = cloud.select("idx").join(owners, "idx", "left")
    return joined.agg(F.count("*").alias("n_points"), F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("n_wrong"))


#: A grid of 64 cells along the longer side of the cloud's extent.
EXTENT = "geom AS (SELECT *, cast(floor(w / cell) AS BIGINT) + 1 AS nx, cast(floor(h / cell) AS BIGINT) + 1 AS ny FROM (SELECT *, greatest(0.5::DOUBLE, greatest(w, h) / 64.0::DOUBLE) AS cell FROM (SELECT min(x) AS gx0, min(y) AS gy0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM pts)))"


def _cell_sql(value: str, axis: str) -> str:
    return f"cast(least(greatest(floor(({value} - g{axis}0) / cell), 0), n{axis} - 1) AS BIGINT)"


CELLS = f"cells AS (SELECT {_cell_sql('x', 'x')} AS cx, {_cell_sql('y', 'y')} AS cy, count(*) AS n FROM pts, geom GROUP BY ALL)"


def _cell_grid(cloud: DataFrame) -> tiling.CellGrid:
    return tiling.cell_grid(tiling.plane_extent(cloud)[0], max_cells=64)


def _cells(spark, sf) -> tuple[DataFrame, tiling.CellGrid]:
    cloud = views.pts(spark, sf)
    grid = _cell_grid(cloud)
    return tiling.count_grid(cloud, grid), grid


@query("SELECT * FROM cells", "pts", EXTENT, CELLS)
def count_grid(spark, sf):
    return _cells(spark, sf)[0]


RECTS = "rects AS (SELECT s_suppkey AS rect_id, s_suppkey % 40 * 10.0::DOUBLE AS x0, s_suppkey % 11 * 10.0::DOUBLE AS y0, s_suppkey % 40 * 10.0::DOUBLE + s_suppkey % 7 * 9 - 5 AS x1, s_suppkey % 11 * 10.0::DOUBLE + 30 AS y1 FROM supplier)"


@query(f"SELECT rect_id, coalesce((SELECT sum(n) FROM cells WHERE cx BETWEEN {_cell_sql('x0', 'x')} AND {_cell_sql('x1', 'x')} AND cy BETWEEN {_cell_sql('y0', 'y')} AND {_cell_sql('y1', 'y')} AND x1 >= x0), 0)::BIGINT AS n FROM rects, geom", "pts", EXTENT, CELLS, RECTS)
def rect_counts(spark, sf):
    cells, grid = _cells(spark, sf)
    s = F.col("s_suppkey")
    rects = spark.read.parquet(f"{sf}/supplier.parquet").select(s.alias("rect_id"), (s % 40 * 10.0).alias("x0"), (s % 11 * 10.0).alias("y0"), (s % 40 * 10.0 + s % 7 * 9 - 5).alias("x1"), (s % 11 * 10.0 + 30).alias("y1"))
    return tiling.rect_count(cells, rects, grid)


@query("SELECT a.cx, b.cy, coalesce((SELECT sum(n) FROM cells c WHERE c.cx <= a.cx AND c.cy <= b.cy), 0)::BIGINT AS total FROM (SELECT DISTINCT cx FROM cells) a, (SELECT DISTINCT cy FROM cells) b", "pts", EXTENT, CELLS)
def prefix_sums(spark, sf):
    return tiling.prefix_sums(_cells(spark, sf)[0])


@query("SELECT cy, cx AS cut FROM (SELECT DISTINCT cy, cx, lag(cx) OVER (PARTITION BY cy ORDER BY cx) AS prev FROM cells) WHERE cx - prev > 1", "pts", EXTENT, CELLS)
def gap_cuts(spark, sf):
    return tiling.gap_cuts(_cells(spark, sf)[0], "x", ["cy"])


@query("""SELECT piece_id, side, x0, y0, x1, y1 FROM (
    SELECT piece_id, 'left' AS side, x0, y0, bx0 AS x1, y1 FROM boxes WHERE bx0 > x0
    UNION ALL SELECT piece_id, 'right', bx1, y0, x1, y1 FROM boxes WHERE bx1 < x1
    UNION ALL SELECT piece_id, 'bottom', bx0, y0, bx1, by0 FROM boxes WHERE by0 > y0
    UNION ALL SELECT piece_id, 'top', bx0, by1, bx1, y1 FROM boxes WHERE by1 < y1)""",
    "boxes AS (SELECT s_suppkey AS piece_id, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 100.0::DOUBLE AS x1, 80.0::DOUBLE AS y1, (s_suppkey % 3 * 10)::DOUBLE AS bx0, (s_suppkey % 2 * 10)::DOUBLE AS by0, (100 - s_suppkey % 5 * 10)::DOUBLE AS bx1, (80 - s_suppkey % 4 * 10)::DOUBLE AS by1 FROM supplier)")
def rect_minus(spark, sf):
    s = F.col("s_suppkey")
    ends = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(100.0), "y1": F.lit(80.0), "bx0": s % 3 * 10.0, "by0": s % 2 * 10.0, "bx1": 100.0 - s % 5 * 10, "by1": 80.0 - s % 4 * 10}
    return tiling.rect_minus(spark.read.parquet(f"{sf}/supplier.parquet").select(s.alias("piece_id"), *[v.alias(k) for k, v in ends.items()]))


def _planned(cloud: DataFrame, pieces: DataFrame, buffer: float, budget: int) -> DataFrame:
    """One row: points, those that are not in exactly one piece, whether each labelled window keeps the budget, whether any tile was cut."""
    named = checkpointed(pieces.select("total", "path", F.concat_ws("/", F.col("tile_id"), "path").alias("piece_id"), "x0", "y0", "x1", "y1"))
    wrong = labels.partition_check(cloud, named).agg(F.count("*").alias("n_wrong"))
    windows = tiling.assign_pieces(cloud, named.where("total > 0"), buffer).groupBy("piece_id").agg(F.count("*").alias("n"))
    fits = windows.agg((F.max("n") <= budget).alias("within_budget"))
    return cloud.agg(F.count("*").alias("n_points")).crossJoin(wrong).crossJoin(fits).crossJoin(named.agg((F.max(F.length("path")) > 0).alias("any_cut")))


#: Cuts are needed, and windows can be cut to an eighth of the cloud (a window's halo is 2 m).
BUDGETED = "counts AS (SELECT max(n) AS fullest FROM (SELECT count(*) AS n FROM pts JOIN tiles t ON x BETWEEN t.x0 - 2 AND t.x1 + 2 AND y BETWEEN t.y0 - 2 AND t.y1 + 2 GROUP BY tile_id))"


@query("SELECT count(*) AS n_points, 0::BIGINT AS n_wrong, true AS within_budget, (SELECT fullest FROM counts) > count(*) // 8 AS any_cut FROM pts", "pts", TILES, BUDGETED)
def split_dense(spark, sf):
    """Tiles cut until windows hold at most an eighth of the cloud: a partition of the points, within the budget."""
    cloud = views.pts(spark, sf).select("idx", "x", "y")
    budget = max(cloud.count() // 8, 1)
    return _planned(cloud, checkpointed(tiling.plan_tiles(cloud, _grid(cloud), 2.0, budget)), 2.0, budget)


@query("SELECT count(*) + 1 AS n_points, 0::BIGINT AS n_wrong, true AS within_budget, true AS any_cut FROM pts", "pts")
def refine_dense(spark, sf):
    """The cloud and a stray point 3,000 km away: the first count grid resolves nothing, grids of the dense pieces do."""
    cloud = views.pts(spark, sf).select("idx", "x", "y")
    stray = cloud.agg(F.lit(-1).cast("long").alias("idx"), F.lit(3e6).alias("x"), F.lit(3e6).alias("y"))
    both = checkpointed(cloud.unionByName(stray))
    budget = max(both.count() // 8, 1)
    return _planned(both, checkpointed(tiling.plan_tiles(both, tiling.tile_grid(both, budget), 2.0, budget)), 2.0, budget)


@query("SELECT idx, tile_id AS piece_id FROM pairs", "pts", TILES, PAIRS)
def piece_assign(spark, sf):
    cloud = views.pts(spark, sf)
    pieces = _grid(cloud).tiles(spark).withColumnRenamed("tile_id", "piece_id")
    return tiling.assign_pieces(cloud.select("idx", "x", "y"), pieces, HALO).select("idx", "piece_id")


@query("SELECT idx, 0::BIGINT AS n FROM pts WHERE x >= 100 AND x < 200", "pts")
def partition_check(spark, sf):
    """Tiles without the columns from 100 to 200: their points are in no piece."""
    cloud = views.pts(spark, sf).select("idx", "x", "y")
    pieces = _grid(cloud).tiles(spark).where("x0 < 100 or x0 >= 200").withColumnRenamed("tile_id", "piece_id")
    return labels.partition_check(cloud, pieces)


# --- labelling ------------------------------------------------------------------


def by_place(xyz: np.ndarray) -> np.ndarray:
    """A model that only looks at x."""
    return (np.floor(xyz[:, 0] / 37).astype(np.int64) % 7 + 1).astype(np.int32)


LABELS = "lab AS (SELECT idx, cast(cast(floor(x / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label FROM pts)"


def _tiled(spark, sf) -> DataFrame:
    cloud = views.pts(spark, sf)
    return labelling.label_planned(cloud, _grid(cloud), by_place, HALO, 100_000)


@query("SELECT idx, label FROM lab", "pts", LABELS)
def label_tiled(spark, sf):
    return _tiled(spark, sf)


@query("SELECT idx, label FROM lab", "pts", LABELS)
def label_rows(spark, sf):
    return labelling.label_rows(views.pts(spark, sf), by_place)


VOXEL_CODES = "cls AS (SELECT model_id AS label, asprs_code AS code FROM (" + views.CLASSES + ") WHERE model = 'voxel')"


@query("SELECT c.range::INTEGER AS code, count(l.idx) AS n FROM range(256) c LEFT JOIN (SELECT idx, code FROM lab JOIN cls USING (label)) l ON l.code = c.range GROUP BY 1", "pts", LABELS, VOXEL_CODES)
def class_histogram(spark, sf):
    coded = labels.apply_codes(_tiled(spark, sf), views.classes(spark, "voxel"))
    return labels.class_histogram(coded)


@query("SELECT idx, model_id, cast(code AS SMALLINT) AS classification FROM pts JOIN lab USING (idx) JOIN cls USING (label)", "pts", LABELS, VOXEL_CODES)
def classify(spark, sf):
    """The whole way: tiles, halos, model, merge, codes."""
    found = labelling.classify(views.pts(spark, sf), by_place, views.classes(spark, "voxel"), tile_size=50.0, target=1000, buffer=HALO)
    return found.select("idx", "model_id", "classification")


@query("SELECT idx, cast(label AS SMALLINT) AS code FROM lab", "pts", LABELS)
def raw_ids(spark, sf):
    return labels.apply_codes(_tiled(spark, sf), views.classes(spark, "voxel"), raw_ids=True)


@query("SELECT model_id AS label, count(*) AS n FROM pts WHERE model_id NOT IN (1, 2, 3) GROUP BY 1", "pts")
def unmapped_ids(spark, sf):
    known = views.classes(spark, "voxel").where("model_id <= 3")
    return labels.unmapped(views.pts(spark, sf).select("idx", F.col("model_id").alias("label")), known)


@query("SELECT idx FROM pts WHERE x >= 100", "pts")
def uncovered_points(spark, sf):
    cloud = views.pts(spark, sf)
    return labels.uncovered(cloud, cloud.where("x < 100").select("idx", F.lit(1).alias("label"))).select("idx")


@query("SELECT (SELECT count(*) FROM pts) AS n_points, (SELECT count(*) FROM pts WHERE x >= 100) AS n_uncovered, (SELECT count(*) FROM pts WHERE x < 20) AS n_repeated", "pts")
def coverage(spark, sf):
    cloud = views.pts(spark, sf)
    found = cloud.where("x < 100").select("idx", F.lit(1).alias("label"))
    return labels.coverage(cloud, found.unionByName(cloud.where("x < 20").select("idx", F.lit(2).alias("label"))))


@query("SELECT idx, label FROM lab WHERE x_lt UNION ALL SELECT idx, 0 FROM lab WHERE NOT x_lt", "pts", "lab AS (SELECT idx, x < 100 AS x_lt, cast(cast(floor(x / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label FROM pts)")
def merge_labels(spark, sf):
    cloud = views.pts(spark, sf)
    return labels.merge_labels(cloud.select("idx"), labelling.label_rows(cloud.where("x < 100"), by_place)).fillna(0, ["label"])


@query("SELECT idx, cast(asprs_code AS SMALLINT) AS code FROM pts JOIN classes USING (model_id) WHERE model = 'rail'", "pts", "classes")
def map_codes(spark, sf):
    return labels.map_codes(views.pts(spark, sf).select("idx", F.col("model_id").alias("label")), views.classes(spark, "rail")).select("idx", "code")


@query("SELECT code, arg_min(color, first_id) AS color, string_agg(name, ' / ' ORDER BY first_id) AS label FROM (SELECT asprs_code AS code, name, min(model_id) AS first_id, arg_min(color, model_id) AS color FROM own GROUP BY 1, 2) GROUP BY 1", "own")
def legend(spark, sf):
    """Legend of a class table kept in the suppliers: several classes a code, names that repeat."""
    return labels.legend(views.view(spark, sf, views.OWN_CLASSES))


@query("SELECT max(code)::INTEGER AS max_code, max(code) > 31 AS needs_upgrade FROM (SELECT asprs_code AS code FROM pts JOIN classes ON classes.model_id = pts.model_id + 2 WHERE model = 'rail')", "pts", "classes")
def needs_upgrade(spark, sf):
    ids = views.pts(spark, sf).select("idx", (F.col("model_id") + 2).alias("label"))
    return labels.needs_upgrade(labels.map_codes(ids, views.classes(spark, "rail")), 3)


AB = "ab AS (SELECT idx, model_id AS a, cast(cast(floor(x / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS b FROM pts)"


def _ab(spark, sf) -> tuple[DataFrame, DataFrame]:
    cloud = views.pts(spark, sf)
    return cloud.select("idx", F.col("model_id").alias("label")), labelling.label_rows(cloud, by_place)


@query("SELECT coalesce(a, 0) AS label, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS share FROM ab GROUP BY ROLLUP (a)", "pts", AB)
def agreement(spark, sf):
    return labels.agreement(*_ab(spark, sf)).fillna(0, ["label"])


@query("SELECT a, b, count(*) AS n FROM ab GROUP BY a, b", "pts", AB)
def confusion(spark, sf):
    return labels.confusion(*_ab(spark, sf))


@query("SELECT coalesce(p.code, q.code) AS code, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT a AS code, count(*) AS n_a FROM ab GROUP BY 1) p FULL JOIN (SELECT b AS code, count(*) AS n_b FROM ab GROUP BY 1) q ON p.code = q.code WHERE n_a IS DISTINCT FROM n_b", "pts", AB)
def cloud_diff(spark, sf):
    return labels.compare_class_counts(*_ab(spark, sf))


@query("""SELECT a.n = b.n AS same_count, abs(a.x0 - b.x0) <= 0.001 AS same_min_x, abs(a.x1 - b.x1) <= 0.001 AS same_max_x, abs(a.y0 - b.y0) <= 0.001 AS same_min_y, abs(a.y1 - b.y1) <= 0.001 AS same_max_y,
    abs(a.z0 - b.z0) <= 0.001 AS same_min_z, abs(a.z1 - b.z1) <= 0.001 AS same_max_z, 'model_id' AS lost_columns FROM
    (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM pts) a,
    (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) + 0.0005 AS z0, max(z) + 0.0005 AS z1 FROM pts WHERE idx % 3 > 0) b""", "pts")
def compare_clouds(spark, sf):
    """The cloud against two thirds of itself, raised by less than the tolerance, without a column."""
    cloud = checkpointed(views.pts(spark, sf))
    return labels.compare_clouds(cloud, cloud.where("idx % 3 > 0").withColumn("z", F.col("z") + 0.0005).drop("model_id"), 0.001)


@query("SELECT idx, x + 1 AS x, 'b' AS side FROM pts WHERE idx % 50 = 0 UNION ALL SELECT idx, x, 'a' FROM pts WHERE idx % 50 = 0", "pts")
def attributes_changed(spark, sf):
    cloud = views.pts(spark, sf).select("idx", "x")
    return labels.assert_same(cloud, cloud.withColumn("x", F.when(F.expr("idx % 50 = 0"), F.col("x") + 1).otherwise(F.col("x"))), ["idx", "x"])


@query("SELECT floor(x / 10) AS x, y, floor(z / 10) AS z, count(DISTINCT model_id) AS n_labels FROM pts GROUP BY 1, 2, 3 HAVING count(DISTINCT model_id) > 1", "pts")
def duplicate_conflicts(spark, sf):
    cloud = views.pts(spark, sf).select(F.floor(F.col("x") / 10).cast("double").alias("x"), "y", F.floor(F.col("z") / 10).cast("double").alias("z"), F.col("model_id").alias("label"))
    return labels.duplicate_conflicts(cloud)


# --- blocks ---------------------------------------------------------------------

SIZE2, SIZE3 = (32.0, 32.0), (32.0, 32.0, 40.0)


def _lattice(size: tuple[float, ...], overlap: float = 0.25) -> tuple[str, str]:
    """SQL of the blocks of a lattice, and of the memberships by comparison with all blocks."""
    axes, box, held, key = "xyz"[: len(size)], [], [], ""
    for c, s in zip(axes, size, strict=True):
        stride = s * (1 - overlap)
        box.append(f"(SELECT g.i AS i{c}, lo + g.i * {stride} AS {c}0, d AS d{c} FROM (SELECT min({c}) AS lo, cast(greatest(floor((max({c}) - min({c}) - {s}) / {stride}) + 1, 0) + 1 AS BIGINT) AS d FROM pts) e, generate_series(0, 2000) g(i) WHERE g.i < d)")
        held.append(f"p.{c} >= b.{c}0 AND p.{c} < b.{c}0 + {s}")
        key = f"({key}) * d{c} + i{c}" if key else f"i{c}"
    return f"lattice AS (SELECT *, {key} AS block_id FROM {', '.join(box)})", f"members AS (SELECT p.*, b.block_id FROM pts p JOIN lattice b ON {' AND '.join(held)})"


@query("SELECT idx, block_id FROM members", "pts", *_lattice(SIZE2))
def sliding_blocks_2d(spark, sf):
    return blocks.sliding_blocks(views.pts(spark, sf), SIZE2, 0.25).select("idx", "block_id")


@query("SELECT idx, block_id FROM members", "pts", *_lattice(SIZE3))
def sliding_blocks_3d(spark, sf):
    return blocks.sliding_blocks(views.pts(spark, sf), SIZE3, 0.25).select("idx", "block_id")


RES, SHAPE = (2.0, 2.0, 4.0), (14, 16, 10)
PLACED = f"""placed AS (SELECT * FROM (SELECT m.*, cast(floor((x - a) / {RES[0]}) AS BIGINT) AS vi, cast(floor((y - b) / {RES[1]}) AS BIGINT) AS vj, cast(floor((z - c) / {RES[2]}) AS BIGINT) AS vk
    FROM members m JOIN (SELECT block_id, min(x) AS a, min(y) AS b, min(z) AS c FROM members GROUP BY 1) USING (block_id))
    WHERE vi BETWEEN 0 AND {SHAPE[0] - 1} AND vj BETWEEN 0 AND {SHAPE[1] - 1} AND vk BETWEEN 0 AND {SHAPE[2] - 1})"""


@query("SELECT idx, block_id, vi, vj, vk FROM placed", "pts", *_lattice(SIZE3), PLACED)
def block_voxels(spark, sf):
    members = blocks.sliding_blocks(views.pts(spark, sf).drop("model_id"), SIZE3, 0.25)
    return blocks.block_voxels(members, RES, SHAPE).select("idx", "block_id", "vi", "vj", "vk")


def by_voxel(voxels: np.ndarray) -> np.ndarray:
    """A model that only looks at a block's occupied voxels."""
    return ((voxels[:, 0] + 2 * voxels[:, 1] + 3 * voxels[:, 2]) % 5 + 1).astype(np.int32)


SHAPE_FULL = (16, 16, 10)
PLACED_FULL = PLACED.replace(f"BETWEEN 0 AND {SHAPE[0] - 1} AND vj", f"BETWEEN 0 AND {SHAPE_FULL[0] - 1} AND vj")


@query("SELECT p.idx, coalesce(arg_max((vi + 2 * vj + 3 * vk) % 5 + 1, block_id), 0)::INTEGER AS label FROM pts p LEFT JOIN placed USING (idx) GROUP BY p.idx", "pts", *_lattice(SIZE3), PLACED_FULL)
def block_last_wins(spark, sf):
    return labelling.label_blocks(views.pts(spark, sf), by_voxel, RES, SHAPE_FULL, 0.25)


@query("SELECT p.idx, coalesce(bool_or((vi + 2 * vj + 3 * vk) % 5 + 1 > 1), false)::INTEGER + 1 AS label FROM pts p LEFT JOIN placed USING (idx) GROUP BY p.idx", "pts", *_lattice(SIZE3), PLACED_FULL)
def block_or_merge(spark, sf):
    return labelling.label_blocks(views.pts(spark, sf), by_voxel, RES, SHAPE_FULL, 0.25, binary=True)


TILE, IN_TILE = (100.0, 50.0, 160.0, 110.0), "x >= 100 AND x < 160 AND y >= 50 AND y < 110"


def _halo_losses(buffer: float) -> str:
    """SQL: points that the blocks of a tile's core lose with the halo ``buffer``, and core points."""
    window = f"x BETWEEN {TILE[0] - buffer} AND {TILE[2] + buffer} AND y BETWEEN {TILE[1] - buffer} AND {TILE[3] + buffer}"
    return f"""SELECT (SELECT count(*) FROM members WHERE block_id IN (SELECT block_id FROM members WHERE {IN_TILE}) AND NOT ({window})) AS n_different,
    (SELECT count(*) FROM pts WHERE {IN_TILE}) AS n_core"""


def _compared_blocks(cloud: DataFrame, buffer: float) -> DataFrame:
    different = blocks.same_blocks(cloud, TILE, buffer, SIZE2, 0.25).agg(F.count("*").alias("n_different"))
    return different.crossJoin(cloud.where(IN_TILE).agg(F.count("*").alias("n_core")))  # one row each


@query(_halo_losses(32.0), "pts", *_lattice(SIZE2))
def tiled_equals_untiled_blocks(spark, sf):
    return _compared_blocks(views.pts(spark, sf), 32.0)


@query(_halo_losses(10.0), "pts", *_lattice(SIZE2))
def tiled_blocks_short_buffer(spark, sf):
    """A halo below a block: how many points the core's blocks lose."""
    return _compared_blocks(views.pts(spark, sf), 10.0)


@query("""SELECT block_id, idx, round(cast(fx - mx AS DOUBLE), 2) + 0.0 AS nx, round(cast(fy - my AS DOUBLE), 2) + 0.0 AS ny, round(cast((fz - mz) - (lz - mz) AS DOUBLE), 2) AS height FROM single JOIN (
    SELECT block_id, cast(avg(cast(fx AS DOUBLE)) AS REAL) AS mx, cast(avg(cast(fy AS DOUBLE)) AS REAL) AS my, cast(avg(cast(fz AS DOUBLE)) AS REAL) AS mz, min(fz) AS lz FROM single GROUP BY 1) USING (block_id)""",
    "pts", *_lattice(SIZE2), "single AS (SELECT block_id, idx, cast(x AS REAL) AS fx, cast(y AS REAL) AS fy, cast(z AS REAL) AS fz FROM members)")
def normalize_crop(spark, sf):
    members = blocks.sliding_blocks(views.pts(spark, sf), SIZE2, 0.25)
    out = points.normalize_group(members, "block_id")
    return out.select("block_id", "idx", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("nx", "ny", "height")])


# --- neighbours and crops -------------------------------------------------------


@query("""SELECT center, idx, round(d2, 6) AS d2, rank FROM (
    SELECT c.idx AS center, p.idx, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z) AS d2,
           row_number() OVER (PARTITION BY c.idx ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z), p.idx) AS rank
    FROM vecs c JOIN vecs p ON (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z) <= 36) WHERE rank <= 8""", "vecs")
def knn_radius(spark, sf):
    cloud = views.vecs(spark, sf)
    return neighbors.knn_crops(cloud, cloud.select("idx"), 8, 6.0).select("center", "idx", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query("SELECT idx, true AS visited, 0::BIGINT AS n_far FROM pts", "pts")
def cover_all(spark, sf):
    """Each point, whether a crop has it, and how many crops have it from further than the radius or by a distance that is not its own."""
    cloud = views.pts(spark, sf)
    crops = checkpointed(neighbors.cover_all(cloud, 20, 6.0, 40.0))
    centre = cloud.select(F.col("idx").alias("center"), *[F.col(c).alias(f"c{c}") for c in "xyz"])
    true = F.expr("(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)")
    held = cloud.select("idx", "x", "y", "z").join(grown(crops.select("center", "idx", "d2")), "idx").join(grown(centre), "center").select("idx", ((true > 36) | (F.abs(true - F.col("d2")) > 1e-6)).alias("far"))
    seen = held.groupBy("idx").agg(F.count_if("far").alias("n_far"))
    return cloud.select("idx").join(grown(seen), "idx", "left").select("idx", F.col("n_far").isNotNull().alias("visited"), F.coalesce("n_far", F.lit(0)).alias("n_far"))


def everywhere_alike(xyz: np.ndarray) -> np.ndarray:
    """Probabilities that do not depend on the place."""
    return np.tile([0.2, 0.5, 0.3], (len(xyz), 1))


@query("SELECT idx, 2 AS label FROM pts", "pts")
def label_crops(spark, sf):
    return labelling.label_crops(views.pts(spark, sf), everywhere_alike, 20, 6.0, 40.0, 0.5)


def by_crop(xyz: np.ndarray) -> np.ndarray:
    """Probabilities that depend on where in its crop a point is: height above the lowest, distance from the middle."""
    x, y, height = xyz.T.astype(np.float64)
    apart = x * x + y * y
    return np.stack([height / (height + 11.0), apart / (apart + 170.0), np.full(len(xyz), 0.52)], axis=1)


#: Crops of all points within 36 around the first point of each cell of side 20, whose diagonal is less: one round reaches every point.
CROPS = (
    "reps AS (SELECT idx, x, y, z FROM pts WHERE idx IN (SELECT min(idx) FROM vox GROUP BY vx, vy, vz))",
    "cloud AS (SELECT idx, cast(cast(x - ox AS REAL) AS DOUBLE) AS x, cast(cast(y - oy AS REAL) AS DOUBLE) AS y, cast(cast(z - oz AS REAL) AS DOUBLE) AS z FROM reps, (SELECT floor(min(x)) AS ox, floor(min(y)) AS oy, floor(min(z)) AS oz FROM reps))",
    "middles AS (SELECT idx AS center, x, y, z FROM cloud WHERE idx IN (SELECT min(idx) FROM cloud GROUP BY floor(x / 20), floor(y / 20), floor(z / 20)))",
    "crops AS (SELECT center, p.idx, p.x::REAL AS fx, p.y::REAL AS fy, p.z::REAL AS fz FROM middles m JOIN cloud p ON p.x BETWEEN m.x - 37 AND m.x + 37 AND (p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) + (p.z - m.z) * (p.z - m.z) <= 36 * 36)",
    "placed AS (SELECT idx, cast(fx - mx AS DOUBLE) AS x, cast(fy - my AS DOUBLE) AS y, cast((fz - mz) - (lz - mz) AS DOUBLE) AS h FROM crops JOIN (SELECT center, avg(fx::DOUBLE)::REAL AS mx, avg(fy::DOUBLE)::REAL AS my, avg(fz::DOUBLE)::REAL AS mz, min(fz) AS lz FROM crops GROUP BY 1) USING (center))",
    "mean AS (SELECT idx, [avg(h / (h + 11.0)), avg((x * x + y * y) / (x * x + y * y + 170.0)), avg(0.52::DOUBLE)] AS probs FROM placed GROUP BY idx)",
)


@query("SELECT v.idx, list_position(m.probs, list_max(m.probs))::INTEGER AS label FROM vox v JOIN (SELECT vx, vy, vz, min(idx) AS rep FROM vox GROUP BY 1, 2, 3) USING (vx, vy, vz) JOIN mean m ON m.idx = rep", "pts", LOCAL, _vox(0.5), *CROPS)
def label_crops_by_place(spark, sf):
    """Overlapping crops of all that lies within the radius, by a model that looks at the place; votes averaged.

    A crop has at most the voxels of side 0.5 that its ball holds, some 1.6 million.
    """
    return labelling.label_crops(views.pts(spark, sf), by_crop, 2_000_000, 36.0, 20.0, 0.5)


VOTES = "votes AS (SELECT idx, c::INTEGER AS class, ((idx * 7 + c * 13 + v * 5) % 101) / 101.0::DOUBLE AS p FROM pts, range(4) a(c), range(3) b(v))"


def _votes(spark, sf) -> DataFrame:
    rows = views.pts(spark, sf).select("idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("class")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"))
    return rows.select("idx", "class", (F.expr("(idx * 7 + class * 13 + v * 5) % 101") / F.lit(101.0)).alias("p"))


@query("SELECT idx, class, round(avg(p), 6) AS p, count(*) AS visits FROM votes GROUP BY idx, class", "pts", VOTES)
def ensemble_mean(spark, sf):
    return labels.ensemble_mean(_votes(spark, sf)).withColumn("p", F.round("p", 6))


@query("SELECT idx, list_position(probs, list_max(probs))::INTEGER AS label FROM (SELECT idx, list(round(p, 6) ORDER BY class) AS probs FROM (SELECT idx, class, avg(p) AS p FROM votes GROUP BY 1, 2) GROUP BY idx)", "pts", VOTES)
def argmax_label(spark, sf):
    visits = labels.ensemble_mean(_votes(spark, sf))
    probs = visits.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("class", F.round("p", 6).alias("p")))).alias("m"))
    return probs.select("idx", labels.argmax_label(F.col("m.p")).alias("label"))


@query("SELECT idx, unnest(list_transform([x / 100, y / 100, z / 100], lambda v: round(exp(v) / (exp(x / 100) + exp(y / 100) + exp(z / 100)), 6))) AS p, unnest([0, 1, 2]) AS class FROM pts", "pts")
def softmax(spark, sf):
    values = F.array(*[F.col(c) / 100 for c in "xyz"])
    return views.pts(spark, sf).select("idx", F.posexplode(codes.softmax(values)).alias("class", "p")).withColumn("p", F.round("p", 6))


# --- pooling, curves, ragged groups ------------------------------------------------

GRID = "grid AS (SELECT idx, x, y, z, idx % 3 AS batch, cast(trunc(x - a) AS BIGINT) AS gx, cast(trunc(y - b) AS BIGINT) AS gy, cast(trunc(z - c) AS BIGINT) AS gz, model_id, z > 50 AS mask FROM pts, (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM pts))"
POOL = "pool AS (SELECT batch, gx // 8 AS px, gy // 8 AS py, gz // 8 AS pz, avg(x) AS x, max(model_id) AS model_id, count(*) AS n, min(idx) AS head, avg(CASE WHEN mask THEN 1.0 ELSE 0.0 END) > 0.5 AS mask, row_number() OVER (ORDER BY batch, gx // 8, gy // 8, gz // 8) - 1 AS cluster FROM grid GROUP BY batch, gx // 8, gy // 8, gz // 8)"


def _gridded(spark, sf) -> DataFrame:
    return points.grid_coord(views.pts(spark, sf), 1.0).withColumns({"batch": F.expr("idx % 3"), "mask": F.col("z") > 50})


@query("SELECT cluster, batch, px, py, pz, round(x, 4) AS x, model_id, n, head, mask FROM pool", "pts", GRID, POOL)
def grid_pool(spark, sf):
    pooled = pooling.grid_pool(_gridded(spark, sf), 8, ["model_id"], "max")
    return pooled.select("cluster", "batch", "px", "py", "pz", F.round("x", 4).alias("x"), "model_id", "n", "head", "mask")


@query("SELECT g.idx, g.model_id + p.model_id AS model_id FROM grid g JOIN pool p ON g.batch = p.batch AND g.gx // 8 = p.px AND g.gy // 8 = p.py AND g.gz // 8 = p.pz", "pts", GRID, POOL)
def unpool(spark, sf):
    fine = _gridded(spark, sf)
    pooled = checkpointed(pooling.grid_pool(fine, 8, ["model_id"], "max"))
    return pooling.unpool(fine, pooling.pooling_inverse(fine, pooled, 8), pooled, "model_id")


@query("SELECT model_id, 'sum' AS how, round(sum(z), 2) AS z FROM pts GROUP BY 1 UNION ALL SELECT model_id, 'mean', round(avg(z), 2) FROM pts GROUP BY 1 UNION ALL SELECT model_id, 'min', min(z) FROM pts GROUP BY 1 UNION ALL SELECT model_id, 'max', max(z) FROM pts GROUP BY 1", "pts")
def segment_reduce(spark, sf):
    cloud, out = views.pts(spark, sf), None
    for how in ("sum", "mean", "min", "max"):
        part = pooling.segment_reduce(cloud, "model_id", ["z"], how).select("model_id", F.lit(how).alias("how"), F.round("z", 2).alias("z"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT batch, count(*) AS n, (sum(count(*)) OVER (ORDER BY batch))::BIGINT AS \"offset\" FROM grid GROUP BY batch", "pts", GRID)
def group_offsets(spark, sf):
    return pooling.group_offsets(_gridded(spark, sf))


@query("SELECT row_number() OVER (ORDER BY batch, idx) - 1 AS position, batch FROM grid", "pts", GRID)
def expand_offsets(spark, sf):
    return pooling.expand_offsets(pooling.group_offsets(_gridded(spark, sf)))


def _morton(x: str, y: str, z: str) -> str:
    return " | ".join(f"((({c} >> {i}) & 1) << {3 * i + s})" for i in range(16) for c, s in ((x, 2), (y, 1), (z, 0)))


CODED = f"coded AS (SELECT *, (batch << 48) | {_morton('gx', 'gy', 'gz')} AS code FROM grid)"


@query(f"SELECT idx, {_morton('gx', 'gy', 'gz')} AS code, {_morton('gy', 'gx', 'gz')} AS trans FROM grid", "pts", GRID)
def zorder(spark, sf):
    at = [F.col(f"g{c}") for c in "xyz"]
    return _gridded(spark, sf).select("idx", curves.curve_code("z", *at, cubes=True).alias("code"), curves.curve_code("z-trans", *at, cubes=True).alias("trans"))


@query("SELECT idx, gx AS x, gy AS y, gz AS z FROM grid", "pts", GRID)
def zorder_roundtrip(spark, sf):
    at = [F.col(f"g{c}") for c in "xyz"]
    coded = _gridded(spark, sf).select("idx", curves.zorder_encode(*at, cubes=True).alias("code"), curves.cube_of(*at).alias("cube"))
    return coded.select("idx", curves.in_cube(curves.zorder_decode(F.col("code")), F.col("cube")).alias("p")).select("idx", "p.x", "p.y", "p.z")


def _hilbert_sql(bits: int) -> list[str]:
    """The curve's definition level by level: rotations and reflections of the axes, then the bits woven and read as a Gray code."""
    steps, last = [], "SELECT idx, gx, gy, gz, gx AS a0, gy AS a1, gz AS a2 FROM grid"
    for level in range(bits - 1, 0, -1):
        on, low = 1 << level, (1 << level) - 1
        for i in range(3):
            name = f"h{level}_{i}"
            steps.append(f"{name} AS MATERIALIZED ({last})")
            swap = f"CASE WHEN a{i} & {on} > 0 THEN 0 ELSE xor(a0, a{i}) & {low} END"
            other = [f"a{k}" if k != i else f"xor(a{i}, {swap}) AS a{i}" for k in (1, 2)]
            last = f"SELECT idx, gx, gy, gz, CASE WHEN a{i} & {on} > 0 THEN xor(a0, {low}) ELSE xor(a0, {swap}) END AS a0, {', '.join(other)} FROM {name}"
    weave = " | ".join(f"((a{i} >> {b} & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    steps += [f"turned AS MATERIALIZED ({last})", f"woven AS MATERIALIZED (SELECT idx, gx, gy, gz, {weave} AS c0 FROM turned)"]
    for k, shift in enumerate((1, 2, 4, 8, 16, 32)):
        steps.append(f"g{k} AS MATERIALIZED (SELECT idx, gx, gy, gz, xor(c{k}, c{k} >> {shift}) AS c{k + 1} FROM {f'g{k - 1}' if k else 'woven'})")
    return steps


@query("SELECT idx, c6 AS code, gx AS x, gy AS y, gz AS z FROM g5", "pts", GRID, *_hilbert_sql(16))
def hilbert(spark, sf):
    """Codes, each in its cube of 2**16 cells a side, and the cells that both turn back into."""
    at = [F.col(f"g{c}") for c in "xyz"]
    coded = _gridded(spark, sf).select("idx", curves.hilbert_encode(*at, bits=16, cubes=True).alias("code"), curves.cube_of(*at).alias("cube"))
    return coded.select("idx", "code", curves.in_cube(curves.hilbert_decode(F.col("code"), 16), F.col("cube")).alias("p")).select("idx", "code", "p.x", "p.y", "p.z")


@query("SELECT idx, xor(idx, idx >> 1) AS gray, idx AS back FROM pts", "pts")
def gray(spark, sf):
    g = curves.gray_encode(F.col("idx"))
    return views.pts(spark, sf).select("idx", g.alias("gray"), curves.gray_decode(g).alias("back"))


@query("SELECT idx, code, batch, code & ((1::BIGINT << 48) - 1) AS inner_code FROM coded", "pts", GRID, CODED)
def batch_code(spark, sf):
    code = curves.batch_code(F.col("batch"), curves.zorder_encode(*[F.col(f"g{c}") for c in "xyz"], cubes=True))
    return _gridded(spark, sf).select("idx", code.alias("code")).select("idx", "code", curves.batch_split(F.col("code")).alias("p")).select("idx", "code", "p.batch", F.col("p.code").alias("inner_code"))


RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY code, idx) - 1 AS rank FROM coded)"


@query("SELECT idx, code, rank FROM ranked", "pts", GRID, CODED, RANKED)
def serialize_z(spark, sf):
    return pooling.serialize(_gridded(spark, sf), "z", cubes=True).select("idx", "code", "rank")


@query("""SELECT batch, pos // 48 AS patch, pos % 48 AS slot, idx, false AS borrowed FROM placed
    UNION ALL SELECT batch, n // 48, pos % 48, idx, true FROM placed WHERE n > 48 AND n % 48 <> 0 AND pos // 48 = n // 48 - 1 AND pos % 48 >= n % 48""",
    "pts", GRID, CODED, RANKED, "placed AS (SELECT batch, idx, rank - min(rank) OVER (PARTITION BY batch) AS pos, count(*) OVER (PARTITION BY batch) AS n FROM ranked)")
def patches(spark, sf):
    return pooling.patches(checkpointed(pooling.serialize(_gridded(spark, sf), "z", cubes=True)), 48)


# --- units, codes, files ----------------------------------------------------------


@query("SELECT file_id, unit_name, CASE unit_name WHEN 'metre' THEN 1.0 WHEN 'US survey foot' THEN 1200.0::DOUBLE / 3937.0::DOUBLE WHEN 'foot' THEN 0.3048 WHEN 'kilometre' THEN 1000.0 END::DOUBLE AS to_m, CASE unit_name WHEN 'unknown' THEN NULL ELSE unit_name END AS label, CASE unit_name WHEN 'metre' THEN 'metres' WHEN 'US survey foot' THEN 'US survey feet' WHEN 'foot' THEN 'international feet' WHEN 'kilometre' THEN 'kilometres' END AS plural FROM files", "files")
def unit_names(spark, sf):
    factor = units.unit_from_name(F.col("unit_name"))
    return views.files(spark, sf).select("file_id", "unit_name", factor.cast("double").alias("to_m"), units.unit_label(factor).alias("label"), units.unit_plural(factor).alias("plural"))


def _crs(spark) -> DataFrame:
    """Units of some CRS codes: a caller's table."""
    return spark.sql("select * from values (2229, 0.304800609601219D), (3812, 1.0D), (5703, 1.0D) as t(code, to_m)")


FOOT = "(1200.0::DOUBLE / 3937.0::DOUBLE)"
GEO = f"geo AS (SELECT *, CASE file_id % 4 WHEN 0 THEN {FOOT} WHEN 3 THEN NULL ELSE 1.0 END::DOUBLE AS xy, CASE file_id % 4 WHEN 3 THEN NULL ELSE 1.0 END::DOUBLE AS z FROM files)"


@query("SELECT file_id, xy AS xy_to_m, z AS z_to_m, file_id % 4 = 2 AS angular FROM geo", "files", GEO)
def geokey_units(spark, sf):
    found = units.units_from_geokeys(views.files(spark, sf), _crs(spark))
    return found.select("file_id", "geo.xy_to_m", "geo.z_to_m", F.coalesce("geo.angular", F.lit(False)).alias("angular"))


RESOLVED = f"res AS (SELECT file_id, CASE WHEN file_id % 4 = 2 THEN 1.0 WHEN override = 'metre' THEN 1.0 WHEN override = 'us_foot' THEN {FOOT} WHEN override = 'foot' THEN 0.3048 ELSE coalesce(xy, 1.0) END::DOUBLE AS xy_to_m, CASE WHEN file_id % 4 = 2 THEN 1.0 WHEN override = 'metre' THEN 1.0 WHEN override = 'us_foot' THEN {FOOT} WHEN override = 'foot' THEN 0.3048 ELSE coalesce(z, 1.0) END::DOUBLE AS z_to_m, file_id % 4 = 2 AS angular FROM geo)"


@query("SELECT * FROM res", "files", GEO, RESOLVED)
def resolve_units(spark, sf):
    found = units.resolve_units(views.files(spark, sf), _crs(spark), wkt=None)
    return found.select("file_id", "xy_to_m", "z_to_m", "angular")


@query("SELECT p.idx, round(p.x * xy_to_m, 6) AS x, round(p.z * z_to_m, 6) AS z, p.x AS raw_x FROM pts p LEFT JOIN res r ON r.file_id = p.idx % 10", "pts", "files", GEO, RESOLVED)
def to_metres(spark, sf):
    cloud = views.pts(spark, sf).withColumn("file_id", F.expr("idx % 10"))
    out = units.to_metres(cloud, units.resolve_units(views.files(spark, sf), _crs(spark), wkt=None))
    return out.select("idx", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), "raw_x")


@query("SELECT s_suppkey AS file_id, CASE s_suppkey % 4 WHEN 0 THEN 0.3048 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 END::DOUBLE AS xy_to_m, CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 END::DOUBLE AS z_to_m, s_suppkey % 4 = 2 AS angular FROM supplier")
def wkt_units(spark, sf):
    """Compound feet over metres, plain metres with a metric projection, degrees, and a text cut short."""
    texts = (
        'COMPD_CS["c",PROJCS["p",GEOGCS["g",UNIT["degree",0.0174]],PARAMETER["fe",1],UNIT["foot",0.3048]],VERT_CS["v",VERT_DATUM["d",2005],UNIT["metre",1]]]',
        'PROJCRS["p",BASEGEOGCRS["b",DATUM["d",ELLIPSOID["e",6378137,298.2,LENGTHUNIT["foot",0.3048]]]],CONVERSION["c",PARAMETER["fe",7,LENGTHUNIT["foot",0.3048]]],CS[Cartesian,2],LENGTHUNIT["metre",1]]',
        'GEOGCS["WGS 84",DATUM["d",SPHEROID["s",6378137,298.2]],UNIT["degree",0.0174]]',
        'PROJCS["broken",UNIT["metre"',
    )
    key = F.expr("s_suppkey % 4")
    text = F.lit(texts[3])
    for k in (2, 1, 0):
        text = F.when(key == k, texts[k]).otherwise(text)
    found = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("file_id"), units.units_from_wkt(text).alias("u"))
    return found.select("file_id", "u.xy_to_m", "u.z_to_m", F.coalesce("u.angular", F.lit(False)).alias("angular"))


@query("SELECT code, CASE WHEN code <= 22 THEN list_extract([" + ", ".join(f"'{n}'" for n in codes.ASPRS_NAMES) + "], code + 1) WHEN code <= 63 THEN 'Reserved' ELSE 'User definable' END AS name FROM (SELECT DISTINCT cast(idx % 256 AS INTEGER) AS code FROM pts)", "pts")
def asprs_names(spark, sf):
    found = views.pts(spark, sf).select(F.expr("cast(idx % 256 as int)").alias("code")).distinct()
    return found.select("code", codes.asprs_name(F.col("code")).alias("name"))


@query("SELECT file_id, point_format, CASE point_format WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 7 WHEN 4 THEN 9 WHEN 5 THEN 10 ELSE point_format END AS upgraded FROM files", "files")
def format_upgrade(spark, sf):
    return views.files(spark, sf).select("file_id", "point_format", codes.point_format_upgrade(F.col("point_format")).alias("upgraded"))


@query("SELECT idx, cast(round_even((idx % 181 - 90) / 0.006::DOUBLE, 0) AS SMALLINT) AS scan_angle, 6 + (idx % 4 // 2)::INTEGER AS point_format FROM pts", "pts")
def scan_angle(spark, sf):
    old = views.pts(spark, sf).select("idx", F.expr("cast(idx % 181 - 90 as tinyint)").alias("scan_angle_rank"), F.expr("cast(idx % 4 as int)").alias("point_format"))
    return codes.upgrade_schema(old, keep_rank=False).select("idx", "scan_angle", "point_format")


@query("""SELECT s_suppkey AS file_id, 'label' AS field, CASE WHEN s_suppkey % 5 = 1 THEN 'exists with other capitals' WHEN s_suppkey % 5 = 2 THEN 'exists and is no unscaled whole number' END AS error FROM supplier""")
def label_field_audit(spark, sf):
    s = F.col("s_suppkey")
    dims = spark.read.parquet(f"{sf}/supplier.parquet").select(s.alias("file_id"), F.when(s % 5 == 1, "Label").when(s % 5 == 4, "other").otherwise("label").alias("dim"), F.when(s % 5 == 2, "f").otherwise("u").alias("kind"), F.lit(1).alias("n"), F.lit(False).alias("scaled"))
    return codes.audit_label_field(dims, " label ")


@query("SELECT file_id, concat('/out/tile_', file_id, '_classified', CASE file_id % 3 WHEN 0 THEN '.las' ELSE '.laz' END) AS out FROM files", "files")
def output_paths(spark, sf):
    return views.files(spark, sf).select("file_id", catalogue.output_path(F.col("path"), "/out", "_classified").alias("out"))


@query("SELECT * FROM (SELECT lower(out) AS out, 'several results' AS reason FROM plan GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT out, 'an input' FROM plan WHERE out IN (SELECT path FROM plan))", "files", "plan AS (SELECT path, CASE WHEN file_id % 7 = 0 THEN '/out/same.laz' WHEN file_id % 7 = 1 THEN path ELSE concat('/out/', file_id) END AS out FROM files)")
def output_collisions(spark, sf):
    plan = views.files(spark, sf).select("path", F.expr("case when file_id % 7 = 0 then '/out/same.laz' when file_id % 7 = 1 then path else concat('/out/', cast(file_id as string)) end").alias("out"))
    return catalogue.check_outputs(plan)


@query("SELECT '/in' AS folder, count(*) AS n_files, sum(declared_count)::BIGINT AS points, round(sum(size_mb), 4) AS size_mb FROM files", "files")
def folder_info(spark, sf):
    return catalogue.folder_info(views.files(spark, sf))


@query("SELECT path FROM files WHERE file_id % 9 = 0", "files")
def files_changed(spark, sf):
    base = views.files(spark, sf).select("path", F.col("declared_count").alias("size"), F.col("file_id").alias("modified"))
    return catalogue.files_changed(base, base.withColumn("size", F.when(F.expr("modified % 9 = 0"), F.col("size") + 1).otherwise(F.col("size"))))


@query("SELECT f.file_id, f.declared_count, coalesce(n, 0) AS n FROM (SELECT file_id, CASE WHEN file_id = 3 THEN 7 ELSE coalesce(n, 0) END::BIGINT AS declared_count FROM files LEFT JOIN c USING (file_id)) f LEFT JOIN c USING (file_id) WHERE declared_count <> coalesce(n, 0)", "pts", "files", "c AS (SELECT idx % 10 AS file_id, count(*) AS n FROM pts GROUP BY 1)")
def verify_counts(spark, sf):
    cloud = views.pts(spark, sf).select(F.expr("idx % 10").alias("file_id"))
    counts = cloud.groupBy("file_id").agg(F.count("*").alias("n"))
    declared = views.files(spark, sf).select("file_id").join(counts, "file_id", "left").select("file_id", F.when(F.col("file_id") == 3, 7).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("declared_count"))
    return catalogue.verify_counts(cloud, declared)


@query("SELECT idx % 10 AS file_id, idx % 10 <> 4 AS holds FROM pts GROUP BY 1, 2", "pts")
def bounds_audit(spark, sf):
    cloud = views.pts(spark, sf).withColumn("file_id", F.expr("idx % 10"))
    declared = cloud.groupBy("file_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return catalogue.bounds_audit(cloud, declared.withColumn("max_x", F.when(F.col("file_id") == 4, F.col("max_x") / 2).otherwise(F.col("max_x"))))


SETTINGS = ('{"2": 64, "5": 64}', "", '{"9": 1}', '{"1": 300}', '{"1": 2, "1": 3}', '{"01": 2}', "[1]", '{"1": "2"}')


@query("""SELECT s_suppkey AS setting_id, c.model_id, CASE WHEN s_suppkey % 8 = 0 AND c.model_id IN (2, 5) THEN 64 ELSE asprs_code END AS code, NULL::VARCHAR AS error FROM supplier, (SELECT * FROM classes WHERE model = 'voxel') c WHERE s_suppkey % 8 < 2
    UNION ALL SELECT s_suppkey, -1, -1, CASE s_suppkey % 8 WHEN 2 THEN 'unknown class id' WHEN 3 THEN 'codes must be whole numbers from 0 to 255' WHEN 4 THEN 'repeated class id' WHEN 5 THEN 'keys must be plain whole numbers' WHEN 6 THEN 'not a JSON object of codes' ELSE 'codes must be whole numbers from 0 to 255' END FROM supplier WHERE s_suppkey % 8 >= 2""", "classes")
def merged_codes(spark, sf):
    text = F.get(F.array(*[F.lit(s) for s in SETTINGS]), F.expr("cast(s_suppkey % 8 as int)"))
    settings = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("setting_id"), text.alias("codes"))
    return codes.parse_output_codes(settings, views.classes(spark, "voxel")).fillna(-1, ["model_id", "code"])


@query("""SELECT '{' || string_agg('"' || model_id || '":' || asprs_code, ',' ORDER BY cast(model_id AS VARCHAR)) || '}' AS codes FROM own""", "own")
def output_codes(spark, sf):
    return codes.output_codes_json(views.view(spark, sf, views.OWN_CLASSES))


@query("""SELECT file_id, field, max(ts) AS ts, arg_max(record, ts) AS record FROM (
    SELECT file_id, 'classification' AS field, file_id % 3 AS ts, concat('{"model":"voxel","weights_sha256":"w","field":"classification","encoding":"ASPRS","classes":{"1":{"name":"ground","asprs":2}}}') AS record FROM files
    UNION ALL SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'classification' ELSE 'mine' END, 1, concat('{"model":"rail","weights_sha256":"w","field":"', CASE WHEN file_id % 2 = 0 THEN 'classification","encoding":"ASPRS' ELSE 'mine","encoding":"raw_model_ids' END, '","classes":{"1":{"name":"ground","asprs":2}}}') FROM files) GROUP BY 1, 2""", "files")
def provenance_upsert(spark, sf):
    found = views.files(spark, sf).select("file_id")
    classes = F.array(F.struct(F.lit(1).alias("id"), F.lit("ground").alias("name"), F.lit(2).alias("asprs")))
    old = found.select("file_id", F.lit("classification").alias("field"), F.expr("file_id % 3 * 2").alias("ts"), codes.provenance_json(F.lit("voxel"), F.lit("w"), F.lit("classification"), classes).alias("record"))
    field = F.when(F.expr("file_id % 2 = 0"), "classification").otherwise("mine")
    new = found.select("file_id", field.alias("field"), F.lit(1).cast("long").alias("ts"), codes.provenance_json(F.lit("rail"), F.lit("w"), field, classes).alias("record"))
    return codes.provenance_upsert(old, new)


SQL["provenance_upsert"] = SQL["provenance_upsert"].replace("file_id % 3 AS ts", "file_id % 3 * 2 AS ts")


@query("SELECT s_suppkey AS file_id, CASE s_suppkey % 2 WHEN 0 THEN 'LASF_Projection' ELSE '' END AS kept FROM supplier")
def strip_records(spark, sf):
    record = lambda name: F.struct(F.lit(name).alias("user_id"), F.lit(1).alias("record_id"))
    s = F.col("s_suppkey")
    vlrs = F.when(s % 2 == 0, F.array(record("COPC"), record("LASF_Projection"), record("copc"))).otherwise(F.array(record("Copc")))
    found = spark.read.parquet(f"{sf}/supplier.parquet").select(s.alias("file_id"), vlrs.alias("vlrs"))
    return codes.strip_records(found, "copc").select("file_id", F.array_join("vlrs.user_id", ",").alias("kept"))


# --- LAS, stores, streams --------------------------------------------------------


#: Where the written clouds lie: metres of a projected system.
PLACE = (5e5, 5.5e6, 700.0)


def _stored(spark, sf, parts: int = 4) -> str:
    """The cloud at ``PLACE``, written as LAS files; idx goes along as an extra dimension."""
    path = scratch(spark, "las")
    cloud = views.pts(spark, sf).withColumns({c: F.col(c) + o for c, o in zip("xyz", PLACE, strict=True)})
    las.write_classified(cloud.select("idx", F.col("idx").alias("source_idx"), "x", "y", "z", F.col("model_id").alias("classification")), path, "las", parts=parts, scale=0.01)
    return path


def _back(cloud: DataFrame) -> list:
    return [F.col("source_idx").alias("idx"), *[F.round(F.col(c) - o, 2).alias(c) for c, o in zip("xyz", PLACE, strict=True)]]


@query("SELECT idx, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, cast(model_id AS SMALLINT) AS classification, row_number() OVER (ORDER BY idx) - 1 AS place FROM pts", "pts")
def las_roundtrip(spark, sf):
    """Written as LAS in ranges of idx and read again: what each point has, and its place in the order of all files by their first point."""
    back = checkpointed(las.read_points(spark, _stored(spark, sf), 1000))
    firsts = back.where("record = 0").select(F.col("path").alias("_path"), F.col("source_idx").alias("_head"))
    sizes = back.groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("_n")).join(firsts, "_path")
    starts = sizes.select("_path", (F.sum("_n").over(Window.orderBy("_head")) - F.col("_n")).alias("_start"))  # one row a file
    return back.join(few(starts), back.path == starts._path).select(*_back(back), "classification", (F.col("_start") + F.col("record")).alias("place"))


@query("SELECT count(*) AS points, round(min(x), 2) AS min_x, round(max(x), 2) AS max_x, 0::BIGINT AS unreadable FROM pts", "pts")
def las_headers(spark, sf):
    """Counts and bounds from the headers of written files, points unread."""
    heads = las.scan_headers(spark, _stored(spark, sf, 3))
    return heads.agg(F.sum("declared_count").alias("points"), F.round(F.min("min_x") - PLACE[0], 2).alias("min_x"), F.round(F.max("max_x") - PLACE[0], 2).alias("max_x"), F.count("warning").alias("unreadable"))


@query("SELECT 4::BIGINT AS n_files, 4 * (375 + 54 + 192) + count(*) * 38 AS bytes FROM pts", "pts")
def list_files(spark, sf):
    """A folder of written files, listed: a header, one record of extra dimensions and 38 bytes a point."""
    return catalogue.list_files(spark, _stored(spark, sf)).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def by_metre(xyz: np.ndarray) -> np.ndarray:
    """``by_place`` for clouds at ``PLACE``, stored at 0.01."""
    return by_place(np.round(xyz[:, :1] - PLACE[0], 2))


@query("SELECT idx, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, cast(code AS SMALLINT) AS classification FROM (SELECT *, cast(cast(floor(round(x, 2) / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label FROM pts) JOIN cls USING (label)", "pts", VOXEL_CODES)
def classify_files(spark, sf):
    """A folder of files labelled and written again, the whole way, with windows of at most a third of the cloud: as many rows out as in, each with its label."""
    source, out = _stored(spark, sf, 3), scratch(spark, "las")
    budget = max(views.pts(spark, sf).count() // 3, 1)
    labelling.classify_files(spark, source, out, by_metre, views.classes(spark, "voxel"), tile_size=100.0, budget=budget, need=2.0).collect()
    back = las.read_points(spark, out)
    return back.select(*_back(back), "classification")


@query("SELECT idx, label, cast(code AS SMALLINT) AS classification, 2::BIGINT AS records FROM (SELECT *, cast(cast(floor(round(x, 2) / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label FROM pts) JOIN cls USING (label)", "pts", VOXEL_CODES)
def label_fields(spark, sf):
    """A folder labelled under a field of its own, then its results under classification: both labels, and a record of provenance for each."""
    source, first, second = _stored(spark, sf, 2), scratch(spark, "las"), scratch(spark, "las")
    for folder, out, field in ((source, first, "label"), (first, second, "classification")):
        labelling.classify_files(spark, folder, out, by_metre, views.classes(spark, "voxel"), tile_size=200.0, need=1.0, field=field, suffix="").collect()
    heads = las.scan_headers(spark, second).select(F.explode("vlrs").alias("v"), "path")
    records = heads.where(F.col("v.user_id") == las.PROVENANCE_USER).groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("records"))
    back = las.read_points(spark, second, columns=["path", "source_idx", "label", "classification"])
    return back.join(few(records), F.col("path") == F.col("_path")).select(F.col("source_idx").alias("idx"), "label", "classification", "records")


@query("SELECT idx, f AS file, cast(code AS SMALLINT) AS classification FROM (SELECT *, cast(cast(floor(round(x, 2) / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label FROM pts, range(3) t(f)) JOIN cls USING (label)", "pts", VOXEL_CODES)
def overlapping_files(spark, sf):
    """Three files with the same points, a budget that only one at a time keeps: files are planned and labelled each by itself."""
    cloud = checkpointed(las.read_points(spark, _stored(spark, sf, 1), columns=["x", "y", "z", "source_idx"]))
    copies = cloud.withColumn("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("idx", F.col("source_idx") * 3 + F.col("file"))
    n = views.pts(spark, sf).count()
    found = labelling.classify(copies, by_metre, views.classes(spark, "voxel"), target=n, budget=n, need=50.0, by=("file",))
    return found.select(F.col("source_idx").alias("idx"), "file", "classification")


class Bands:
    """``by_metre`` as a model to load: the table of its bands is made where it runs."""

    context_buffer_m = 1.5

    def load(self) -> None:
        self.bands = np.arange(7, dtype=np.int32) + 1

    def predict(self, xyz: np.ndarray) -> np.ndarray:
        return self.bands[np.floor(np.round(xyz[:, 0], 6) / 37).astype(np.int64) % 7]


@query("SELECT idx, cast(code AS SMALLINT) AS classification FROM (SELECT *, cast(cast(floor(round(x, 6) / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label FROM pts) JOIN cls USING (label)", "pts", VOXEL_CODES)
def label_loaded(spark, sf):
    """A model that workers load once and that says itself how far it looks."""
    cloud = views.pts(spark, sf)
    found = labelling.classify(cloud, Bands(), views.classes(spark, "voxel"), target=max(cloud.count() // 16, 1))
    return found.select("idx", "classification")


@query("SELECT path, CASE WHEN point_format IN (4, 5, 9, 10) THEN 'waveform packets' ELSE 'coordinates in degrees' END AS reason FROM files WHERE point_format IN (4, 5, 9, 10) OR geo_1024 = 2", "files")
def refused_files(spark, sf):
    found = views.files(spark, sf).select("path", F.col("point_format").isin(4, 5, 9, 10).alias("waveforms"), (F.col("geo_1024") == 2).alias("angular"))
    return catalogue.refused(found)


@query("SELECT count(*) AS n_in, count(*) FILTER (k = 0 OR idx % 50 > 0) AS n_out, count(*) = count(*) FILTER (k = 0 OR idx % 50 > 0) AS complete FROM pts, range(2) t(k) GROUP BY k", "pts")
def verify_written(spark, sf):
    """A cloud written whole, and one with some points lost."""
    cloud, out = views.pts(spark, sf), None
    for lost in ("false", "idx % 50 = 0"):
        path = scratch(spark, "classified")
        las.write_classified(cloud.where(f"not ({lost})").withColumn("classification", F.col("model_id").cast("short")), path)
        row = catalogue.verify_written(spark.read.parquet(path), cloud)
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT idx, x, y, z, tile_id FROM pairs WHERE tile_id = 1", "pts", TILES, PAIRS)
def tile_store(spark, sf):
    """Points stored tile by tile; one tile read back by pruning."""
    cloud, path = views.pts(spark, sf), scratch(spark, "tiles")
    catalogue.write_tiles(tiling.assign_tiles(cloud, _grid(cloud), HALO), path)
    return spark.read.parquet(path).where("tile_id = 1").select("idx", "x", "y", "z", F.col("tile_id").cast("long").alias("tile_id"))


def _arriving(spark, sf) -> DataFrame:
    """The events table as a stream, in the form of points."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = arrivals.arrivals(spark, f"{sf}/event[s].parquet", schema)
    kind = F.expr("case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end")
    return rows.select(F.col("event_id").alias("idx"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("z"), kind.alias("model_id"), F.col("_metadata.file_path").alias("path"))


def _finished(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise RuntimeError(str(stream.exception()))


@query("SELECT * FROM cells", "pts", EXTENT, CELLS)
def stream_counts(spark, sf):
    target = scratch(spark, "counts")
    _finished(arrivals.stream_counts(_arriving(spark, sf), _cell_grid(views.pts(spark, sf)), target, scratch(spark, "state")))
    return spark.read.parquet(target)


@query("SELECT idx, round(x, 2) AS x, cast(code AS SMALLINT) AS code, CASE WHEN row_number() OVER (ORDER BY idx) <= first THEN 0 ELSE 1 END AS batch FROM (SELECT *, cast(cast(floor(round(x, 2) / 37) AS BIGINT) % 7 + 1 AS INTEGER) AS label, (SELECT count(*) FROM pts WHERE idx <= (SELECT quantile_disc(idx, 0.5) FROM pts)) AS first FROM pts) JOIN cls USING (label)", "pts", VOXEL_CODES)
def stream_las(spark, sf):
    """LAS files that arrive in two lots, with the stream stopped in between: each labelled once, in the batch of its lot."""
    cloud, folder, log, state, target = views.pts(spark, sf), scratch(spark, "las"), scratch(spark, "log"), scratch(spark, "state"), scratch(spark, "labels")
    half = cloud.agg(F.expr("percentile_disc(0.5) within group (order by idx)")).first()[0]
    for lot in (f"idx <= {half}", f"idx > {half}"):
        part = cloud.where(lot).withColumns({c: F.col(c) + o for c, o in zip("xyz", PLACE, strict=True)}).select("idx", F.col("idx").alias("source_idx"), "x", "y", "z")
        las.write_classified(part, stage := scratch(spark, "las"), "las", parts=2, scale=0.01)
        publishing.move_files(qualified(spark, stage), qualified(spark, folder))
        _finished(arrivals.stream_labels(arrivals.las_arrivals(spark, folder, log), by_metre, views.classes(spark, "voxel"), target, state, tile_size=100.0, need=1.0))
    return spark.read.parquet(target).select(F.col("source_idx").alias("idx"), F.round(F.col("x") - PLACE[0], 2).alias("x"), "code", "batch")


@query("SELECT model_id AS code, count(*) AS n FROM pts GROUP BY 1", "pts")
def stream_histogram(spark, sf):
    target = scratch(spark, "histogram")
    _finished(arrivals.stream_histogram(_arriving(spark, sf), "model_id", target, scratch(spark, "state")))
    return spark.read.parquet(target)


@query("SELECT idx, cast(code AS SMALLINT) AS code FROM lab JOIN cls USING (label)", "pts", LABELS, VOXEL_CODES)
def stream_classify(spark, sf):
    target = scratch(spark, "labels")
    grid = _grid(views.pts(spark, sf))
    _finished(arrivals.stream_classify(_arriving(spark, sf), by_place, views.classes(spark, "voxel"), grid, HALO, target, scratch(spark, "state")))
    return spark.read.parquet(target).select("idx", "code")


@query("SELECT idx % 10 AS file_id, count(*) AS n FROM pts GROUP BY 1", "pts")
def stream_complete(spark, sf):
    target = scratch(spark, "complete")
    file_id = F.expr("idx % 10").alias("file_id")
    declared = checkpointed(views.pts(spark, sf).groupBy(file_id).agg(F.count("*").alias("declared_count")))
    _finished(arrivals.stream_complete(_arriving(spark, sf).select("idx", file_id), declared, target, scratch(spark, "state")))
    return spark.read.parquet(target).select("file_id", "n")
