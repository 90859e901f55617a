import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions import codes, curves, units
from pointloom.operators import blocks, labels, neighbors, points, pooling
from pointloom.plans import labelling
from pointloom.session import checkpointed


def cloud_of(spark, xyz):
    return spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}).astype({"idx": "int64"}))


@pytest.mark.parametrize("top", [1.0, 3.0, 40.0, 120.0])
def test_blocks_hold_every_point(spark, top):
    xyz = np.random.default_rng(int(top)).uniform(0, 1, (300, 3)) * [90, 70, top]
    found = blocks.sliding_blocks(cloud_of(spark, xyz), (33.6, 33.6, 51.2), 0.1)
    assert found.select("idx").distinct().count() == 300
    assert found.count() == found.distinct().count()


def test_single_point_block(spark):
    assert blocks.sliding_blocks(cloud_of(spark, np.array([[5.0, 5.0, 5.0]])), (1.0, 1.0, 1.0)).count() == 1


def test_tiled_blocks_equal_untiled(spark):
    xyz = np.random.default_rng(3).uniform(0, 1, (4000, 3)) * [300, 200, 30]
    cloud = cloud_of(spark, xyz)
    tile, size = (100, 50, 160, 110), (33.6, 33.6)
    assert blocks.same_blocks(cloud, tile, 33.6, size).count() == 0
    lost = blocks.same_blocks(cloud, tile, 5.0, size)  # a halo below a block: points of the core's blocks are missing
    assert lost.count() > 0
    outside = lost.select("idx").distinct().join(cloud, "idx").where(~(F.col("x").between(95, 165) & F.col("y").between(45, 115)))
    assert outside.count() == lost.select("idx").distinct().count()
    window = cloud.where("x between 66.4 and 193.6 and y between 16.4 and 143.6")
    corner = lambda grid: np.array(grid.select("lo_x", "lo_y").first())
    whole, stride = corner(blocks.lattice(cloud, size, 0.1)), 33.6 * 0.9
    assert np.allclose(corner(blocks.lattice(window, size, 0.1, tuple(whole))), whole)
    shift = (corner(blocks.lattice(window, size, 0.1)) - whole) / stride  # without the cloud's origin the lattice moves
    assert (np.abs(shift - np.round(shift)) > 1e-3).all()


def test_voxels_equal_numpy(spark):
    random = np.random.default_rng(1)
    xyz = np.repeat(np.round(random.normal(0, 2, (300, 3)), 2), 3, axis=0)
    cloud = cloud_of(spark, xyz)
    for grid in (0.05, 0.1, 0.3):
        local = (xyz - np.floor(xyz.min(0))).astype(np.float32).astype(float)
        _, first = np.unique(np.floor(local / grid), axis=0, return_index=True)
        assert sorted(r.idx for r in points.voxel_downsample(cloud, grid).collect()) == sorted(first)


def test_knn_equals_brute_force(spark):
    random = np.random.default_rng(2)
    xyz = np.vstack([random.normal(0, 2, (150, 3)), random.uniform(-30, 30, (60, 3)), np.zeros((5, 3))])
    cloud = cloud_of(spark, xyz)
    found = {}
    for r in neighbors.knn_crops(cloud, cloud.select("idx"), 20, 6.0).collect():
        found.setdefault(r.center, []).append((r["rank"], r.idx))
    for c in range(len(xyz)):
        d2 = ((xyz - xyz[c]) ** 2).sum(1)
        want = sorted((d, i) for i, d in enumerate(d2) if d <= 36)[:20]
        assert [i for _, i in sorted(found[c])] == [i for _, i in want] or np.allclose(sorted(d2[[i for _, i in found[c]]]), [d for d, _ in want])


def test_dense_neighbours_meet_few_pairs(spark):
    """1,000 points in one place and 3,000 in 1 m, radius 50 m: exact, and pairs grow with k."""
    dense = np.random.default_rng(9).uniform(0, 1, (3000, 3))
    xyz = np.vstack([np.full((1000, 3), 0.5), dense, np.random.default_rng(10).uniform(0, 100, (50, 3))])
    cloud = checkpointed(cloud_of(spark, xyz))
    some = cloud.where("idx % 40 = 0").select("idx")
    found = {}
    for r in neighbors.knn_crops(cloud, some, 8, 50.0).collect():
        found.setdefault(r.center, []).append((r["rank"], r.idx))
    for c, got in found.items():
        d2 = ((xyz - xyz[c]) ** 2).sum(1)
        want = sorted((d, i) for i, d in enumerate(d2) if d <= 2500)[:8]
        assert np.allclose(sorted(d2[[i for _, i in got]]), [d for d, _ in want])
    assert len(found) == len(xyz) // 40 + 1
    few = cloud.where("idx >= 992")  # 8 of the place
    at = few.where("idx % 40 = 0").select(F.col("idx").alias("center"), "x", "y", "z")
    pairs = neighbors.within_radius(few, neighbors.levels_of(at, neighbors.dense_cells(few, 8, 50.0), 50.0), 50.0).count()
    assert pairs < at.count() * 600 < at.count() * few.count() / 4


def test_offsets_over_many_ranges(spark):
    frame = spark.range(5000).selectExpr("cast(pow(id % 71, 2) as long) as batch")
    offsets = pooling.group_offsets(frame).orderBy("batch").collect()
    assert [r.offset for r in offsets] == list(np.cumsum([r.n for r in offsets]))
    back = pooling.expand_offsets(spark.createDataFrame([(1, 250_000, 250_000), (2, 0, 250_000), (3, 5, 250_005)], "batch long, n long, offset long"))
    assert back.count() == 250_005 and back.agg(F.count_distinct("position")).first()[0] == 250_005 and back.where("batch = 3").agg(F.min("position")).first()[0] == 250_000


def test_crops_cover_coincident_and_dense_points(spark):
    """100 points in one place and 1,500 in a cell of the fill rounds, with crops of at most 5 places."""
    dense = np.random.default_rng(6).uniform(0, 0.5, (1500, 3)) + [300, 0, 0]
    xyz = np.vstack([np.zeros((100, 3)), dense, [[0.0, 0.0, 1.0]]])
    crops = checkpointed(neighbors.cover_all(cloud_of(spark, xyz), 5, 2.0, 40.0))
    assert sorted(r.idx for r in crops.select("idx").distinct().collect()) == list(range(len(xyz)))
    found = crops.toPandas()
    assert not found.duplicated(["center", "idx"]).any() and found["rank"].max() == 5
    assert (found[found.idx == found.center]["rank"] == 1).all() and set(found.center) <= set(found[found["rank"] == 1].idx)
    assert np.allclose(((xyz[found.idx] - xyz[found.center]) ** 2).sum(1), found.d2)
    assert (found[found.idx.between(1, 99)].groupby("idx").size() == 1).all()


def test_crops_label_disconnected_groups(spark):
    """Two groups far apart, each point thrice, labels by height."""
    base = np.array([[5e5 + i % 2, 5.5e6 + i // 2 % 2, 700.0] for i in range(4)])
    xyz = np.repeat(np.vstack([base, base + [200, 0, 50]]), 3, axis=0)

    def model(xyz):
        return np.tile([0.1, 0.9], (len(xyz), 1))

    found = labelling.label_crops(cloud_of(spark, xyz), model, 4, 6.0, 100.0, 0.1)
    assert sorted((r.idx, r.label) for r in found.collect()) == [(i, 2) for i in range(24)]


def test_crop_labels_equal_numpy(spark):
    """Labels by a model that looks at the place, against the same crops run in numpy."""
    xyz = np.round(np.random.default_rng(6).uniform(0, 1, (600, 3)) * [60, 40, 12], 2)
    cloud = cloud_of(spark, xyz)

    def model(p):
        return np.stack([p[:, 2] / (p[:, 2] + 3.1), np.full(len(p), 0.47), np.abs(p[:, 0]) / (np.abs(p[:, 0]) + 2.3)], 1)

    found = {r.idx: r.label for r in labelling.label_crops(cloud, model, 12, 6.0, 9.0, 0.01).collect()}
    local = (xyz - np.floor(xyz.min(0))).astype(np.float32)
    sums, times = np.zeros((len(xyz), 3)), np.zeros(len(xyz))
    crops = neighbors.cover_all(cloud_of(spark, local.astype(float)), 12, 6.0, 9.0).toPandas()
    for _, crop in crops.groupby("center"):
        at = crop.idx.to_numpy()
        place = local[at] - local[at].mean(0, dtype=np.float64).astype(np.float32)
        place[:, 2] -= place[:, 2].min()
        sums[at] += model(place)
        times[at] += 1
    expected = (sums / times[:, None]).argmax(1) + 1
    assert len(set(expected.tolist())) == 3 and found == dict(enumerate(expected.tolist()))


def test_tiled_labels_equal_whole(spark):
    xyz = np.random.default_rng(4).uniform(0, 1, (2000, 3)) * [120, 80, 5]
    cloud = cloud_of(spark, xyz)

    def crowd(p):  # looks at neighbours up to 3 m
        return np.array([min(9, ((np.abs(p - q) <= 3).all(1)).sum()) for q in p], np.int32)

    from pointloom.operators.tiling import tile_grid

    tiled = labelling.label_tiles(cloud, tile_grid(cloud, size=25), crowd, 3.0)
    whole = crowd(xyz)
    labels.assert_covered(cloud, tiled)
    assert {r.idx: r.label for r in tiled.collect()} == dict(enumerate(whole.tolist()))


def test_model_contract(spark):
    with pytest.raises(ValueError):
        labelling.checked(np.zeros(3), 3)
    with pytest.raises(ValueError):
        labelling.checked(np.zeros(2, int), 3)


def test_unmapped_label_fails(spark):
    classes = spark.createDataFrame([(1, 2)], "model_id int, asprs_code int")
    good = spark.createDataFrame([(0, 1)], "idx long, label int")
    assert labels.apply_codes(good, classes).first()["code"] == 2
    bad = spark.createDataFrame([(0, 1), (1, 7)], "idx long, label int")
    with pytest.raises(Exception, match="unmapped"):
        labels.apply_codes(bad, classes).collect()
    with pytest.raises(ValueError):
        labels.assert_covered(bad, good)


def test_zorder_refuses_what_does_not_fit(spark):
    at = [F.col(c) for c in "xyz"]
    fits = spark.createDataFrame([(65535, 0, 1)], "x long, y long, z long")
    assert fits.select(curves.zorder_decode(curves.zorder_encode(*at)).alias("p")).first().p == (65535, 0, 1)
    for bad in [(65536, 0, 0), (0, 65536, 0), (0, 0, -1)]:
        for code in (curves.zorder_encode(*at), curves.curve_code("z-trans", *at), curves.hilbert_encode(*at)):
            with pytest.raises(Exception, match="does not fit in 16 bits"):
                spark.createDataFrame([bad], "x long, y long, z long").select(code).collect()
    with pytest.raises(Exception, match="does not fit in 4 bits"):
        spark.createDataFrame([(16, 0, 0)], "x long, y long, z long").select(curves.zorder_encode(*at, depth=4)).collect()


def test_hilbert_steps():
    for bits in (1, 2, 3):
        n = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
        code = curves.hilbert_index(*cells.T, bits)
        assert sorted(code) == list(range(n**3))
        assert (np.abs(np.diff(cells[np.argsort(code)], axis=0)).sum(1) == 1).all()
        assert (np.stack(curves.hilbert_axes(code, bits), -1) == cells).all()


def test_batch_must_fit(spark):
    with pytest.raises(Exception, match="fit"):
        spark.range(1).select(curves.batch_code(F.lit(1 << 20), F.lit(0).cast("long"), 16)).collect()


FT = 1200 / 3937


@pytest.mark.parametrize("text, want", [
    ('COMPD_CS["x",PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["s",1,2]],UNIT["degree",0.0174]],PROJECTION["m"],PARAMETER["e",1],UNIT["US survey foot",0.3048006096012192]],VERT_CS["v",VERT_DATUM["d",2005],UNIT["US survey foot",0.3048006096012192]]]', (FT, FT, False)),
    ('PROJCRS["p",BASEGEOGCRS["b",DATUM["d",ELLIPSOID["e",1,2,LENGTHUNIT["metre",1]]]],CONVERSION["c",PARAMETER["e",1,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["x",east,ORDER[1],LENGTHUNIT["US survey foot",0.304800609601219]]]', (FT, FT, False)),
    ('PROJCS["p",UNIT["metre",0]]', (1.0, 1.0, False)),
    ('PROJCS["p",UNIT["kilometre",-5]]', (1000.0, 1000.0, False)),
    ('LOCAL_CS["l",UNIT["ft",NaN]]', (0.3048, 0.3048, False)),
    ('GEOGCS["WGS 84",UNIT["degree",0.0174]]', (1.0, 1.0, True)),
    ('PROJCS["broken",UNIT["metre"', None), ("", None), (None, None), ("]", None), ('PROJCS["no unit"]', None),
    ('PROJCS("round",UNIT("metre",1))', (1.0, 1.0, False)),
])
def test_wkt(text, want):
    found = units.wkt_units(text)
    assert found == want if want is None else found == pytest.approx(want)


def test_vertical_unit_and_override(spark):
    crs = spark.createDataFrame([(2229, FT)], "code int, to_m double")
    rows = [(1, 1, 2229, None, 5703, None, "auto"), (2, 1, 2229, None, 5703, None, "foot"), (3, 2, None, None, None, None, "metre"), (4, 1, 2229, 9003, None, 9001, "metre")]
    files = spark.createDataFrame(rows, "file_id int, geo_1024 int, geo_3072 int, geo_3076 int, geo_4096 int, geo_4099 int, override string")
    with pytest.raises(Exception, match="5703"):
        units.resolve_units(files, crs, wkt=None).collect()
    found = {r.file_id: r for r in units.resolve_units(files.where("file_id > 1"), crs, wkt=None).collect()}
    assert found[2].xy_to_m == 0.3048 and found[3].angular
    assert found[4].xy_to_m == 1 and "US survey feet (XY) and metres (Z)" in found[4].conflict


def test_output_codes(spark):
    classes = spark.createDataFrame([(1, 2), (2, 5)], "model_id int, asprs_code int")
    bad = ["[1]", "{", '{"1":}', '{"1":1.5}', '{"1":true}', '{"1":-1}', '{"1":256}', '{"3":1}', '{"1":1,"1":2}', '{" 1":1}', '{"1":"2"}', '{"1":null}', "5", '{"1":[2]}']
    good = ['{"1": 64}', "", "  ", "{}", '{"1":7,"2":7}']
    frame = spark.createDataFrame([(k, s) for k, s in enumerate([*bad, *good])] + [(99, None)], "setting_id int, codes string")
    found = codes.parse_output_codes(frame, classes).collect()
    wrong = {r.setting_id for r in found if r.error}
    assert wrong == set(range(len(bad)))
    assert {(r.model_id, r.code) for r in found if r.setting_id == len(bad)} == {(1, 64), (2, 5)}


def test_sql_functions(spark):
    codes.register(spark)
    row = spark.sql("select asprs_name(2) a, asprs_name(40) b, asprs_name(64) c, point_format_upgrade(3) d, scan_angle(15) e").first()
    assert tuple(row) == ("Ground", "Reserved", "User definable", 7, 2500)
    curves.register(spark)
    units.register(spark)
    row = spark.sql("select zorder_encode(5, 3, 1) z, gray_decode(gray_encode(123456789)) g, unit_label(unit_from_name('US survey foot')) u, unit_label(1000D) k, unit_from_name('rod') r").first()
    want = spark.range(1).select(curves.zorder_encode(F.lit(5), F.lit(3), F.lit(1))).first()[0]
    assert tuple(row) == (want, 123456789, "US survey foot", "kilometre", None)
    code = spark.range(1).select(curves.hilbert_encode(F.lit(5).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long"))).first()[0]
    row = spark.sql(f"select zorder_decode(zorder_encode(5, 3, 65535)) z, hilbert_encode(5L, 3L, 1L) h, hilbert_decode({code}L) p, batch_split(batch_code(7, 99)) b, unit_plural(0.3048D) u").first()
    assert (tuple(row.z), row.h, tuple(row.p), tuple(row.b), row.u) == ((5, 3, 65535), code, (5, 3, 1), (7, 99), "international feet")
    for bad in ("zorder_encode(65536, 0, 0)", "hilbert_encode(-1L, 0L, 0L)", "batch_code(32768, 1)"):
        with pytest.raises(Exception, match="fit"):
            spark.sql(f"select {bad}").collect()


def test_duplicates_share_label(spark):
    frame = spark.createDataFrame([(1.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, 2), (2.0, 1.0, 1.0, 3)], "x double, y double, z double, label int")
    assert labels.duplicate_conflicts(frame).collect()[0].n_labels == 2


def test_ranks_of_a_cloud_in_a_corner_are_dealt_evenly(spark):
    """All codes in the lowest corner of the curve, a third of them equal: no range has twice the mean, ranks are those of one sort."""
    steps = [(i, 0, *((5, 5, 5) if i % 3 == 0 else (i % 97, i % 89, i % 7))) for i in range(6000)]
    cloud = spark.createDataFrame(steps, "idx long, batch long, gx long, gy long, gz long")
    done = checkpointed(pooling.serialize(cloud, "z", parts=8).withColumn("range", F.spark_partition_id()))
    sizes = [r["count"] for r in done.groupBy("range").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * len(steps) / 8
    rows = done.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(6000)) and [(r.code, r.idx) for r in rows] == sorted((r.code, r.idx) for r in rows)


@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 7))
def test_crops_are_whole_however_batches_cut_them(centers, size):
    centers = sorted(centers)
    rows = pa.record_batch({"center": pa.array(centers, pa.int64()), "idx": pa.array(range(len(centers)), pa.int64())})
    batches = [rows.slice(at, size) for at in range(0, len(centers), size)]
    tables = list(labelling._whole_crops([rows.slice(0, 0), *batches]))
    held = [set(table.column("center").to_pylist()) for table in tables]
    assert sum(map(len, held)) == len(set(centers))  # no crop is in two tables
    assert [v for table in tables for v in table.column("idx").to_pylist()] == list(range(len(centers)))
    assert all(len(table) < size + max(centers.count(c) for c in found) + size for table, found in zip(tables, held, strict=True))


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=30), st.integers(1, 9))
def test_crop_votes_are_those_of_each_crop(rows, size):
    rows = sorted(rows)
    cols = {"center": [c for c, _ in rows], "idx": list(range(len(rows))), **{a: [float(v + n) for _, v in rows] for n, a in enumerate("xyz")}}
    batch = pa.record_batch({k: pa.array(v, pa.int64() if k in ("center", "idx") else pa.float64()) for k, v in cols.items()})
    found = [row for out in labelling._crop_votes(lambda xyz: np.stack([xyz[:, 2], np.full(len(xyz), len(xyz))], axis=1), [batch.slice(at, size) for at in range(0, len(rows), size)]) for row in out.to_pylist()]
    lowest, count = {}, {}
    for c, v in rows:
        lowest[c], count[c] = min(lowest.get(c, v), v), count.get(c, 0) + 1
    assert [row["idx"] for row in found] == cols["idx"]
    np.testing.assert_allclose([row["probs"] for row in found], [[v - lowest[c], count[c]] for c, v in rows], atol=1e-5)
