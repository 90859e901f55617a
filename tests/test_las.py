"""LAS files written with numpy, and by the sink."""

import json
import os
import struct
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.plans import labelling, models
from pointloom.session import checkpointed
from pointloom.sources import files, las, publishing


def las_bytes(n, fmt=3, extra=(), vlrs=(), count=None):
    """A small LAS 1.2 file with points on a line, for reading tests."""
    dtype = np.dtype(las.FORMATS[fmt] + [(name, t) for name, t in extra])
    data = np.zeros(n, dtype)
    data["X"], data["Y"], data["Z"] = np.arange(n), np.arange(n) * 2, 5
    if fmt < 6:
        data["_class"], data["_returns"] = np.arange(n) % 32 | 128, 0b00_010_001
    for k, (name, t) in enumerate(extra):
        data[name] = np.uint64(2**63) + np.arange(n, dtype=np.uint64) if t == "<u8" else k
    records = list(vlrs)
    if extra:
        body = b"".join(struct.pack("<2xBB32s4x72x24x24x32x", las._EXTRA.index(t) + 1, 0, name.encode()) for name, t in extra)
        records.append((b"LASF_Spec", 4, body))
    raw = b"".join(struct.pack("<H16sHH32s", 0, u, r, len(d), b"") + d for u, r, d in records)
    head = bytearray(227)
    struct.pack_into("<4sHH", head, 0, b"LASF", 0, 0)
    head[24], head[25] = 1, 2
    struct.pack_into("<HIIBHI", head, 94, 227, 227 + len(raw), len(records), fmt, dtype.itemsize, n if count is None else count)
    struct.pack_into("<12d", head, 131, 0.5, 0.5, 0.1, 100.0, 0.0, 0.0, 100 + n / 2, 100, n, 0, 1, 0)
    return bytes(head) + raw + data.tobytes()


def test_reads_ranges_bits_and_exact_extras(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_bytes(27, extra=[("big", "<u8"), ("small", "u1")]))
    found = las.register(spark).read.format("las").option("range", 10).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    rows = found.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(27))
    assert (rows[3].x, rows[3].y, round(rows[3].z, 6), rows[3].raw_x) == (101.5, 3.0, 0.5, 3)
    assert int(rows[26].big) == 2**63 + 26
    assert (rows[5].classification, rows[5].withheld, rows[5].return_number, rows[5].number_of_returns) == (5, 1, 1, 2)


def test_short_file_fails(spark, tmp_path):
    whole = las_bytes(10)
    (tmp_path / "a.las").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends before"):
        las.register(spark).read.format("las").load(str(tmp_path / "a.las")).count()


def test_headers_list_unreadable_files(spark, tmp_path):
    wkt = b'PROJCS["p",UNIT["metre",1]]\0'
    (tmp_path / "a.las").write_bytes(las_bytes(10, vlrs=[(b"LASF_Projection", 2112, wkt), (b"copc", 1, b"x")]))
    (tmp_path / "b.las").write_bytes(b"no las")
    rows = {r.path[-5:]: r for r in las.scan_headers(spark, str(tmp_path)).collect()}
    assert rows["a.las"].declared_count == 10 and rows["a.las"].wkt.startswith("PROJCS") and len(rows["a.las"].vlrs) == 2
    assert rows["b.las"].declared_count == 0 and rows["b.las"].warning


def test_write_las_keeps_order_columns_and_old_output_on_failure(spark, tmp_path):
    cloud = spark.range(1000).select(F.col("id").alias("idx"), F.col("id").alias("mine"), (F.col("id") / 10).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), F.expr("cast(id % 200 as smallint)").alias("classification"))
    out = str(tmp_path / "out")
    las.write_classified(cloud, out, "las", parts=3)
    back = spark.read.format("las").load(out)
    assert back.count() == 1000
    assert [(r.mine, r.classification) for r in back.orderBy("path", "idx").where("mine % 333 = 0").orderBy("mine").collect()] == [(0, 0), (333, 133), (666, 66), (999, 199)]
    per_file = back.groupBy("path").agg(F.max(F.col("mine") - F.col("idx")).alias("a"), F.min(F.col("mine") - F.col("idx")).alias("b")).collect()
    assert all(r.a == r.b for r in per_file)  # ranges of idx, in order
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    bad = cloud.withColumn("x", F.when(F.col("idx") == 999, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception):
        las.write_classified(bad, out, "las", parts=3)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before


def folder_of_files(path, counts=(200, 150), fmt=3):
    """LAS files around (5e5, 5.5e6, 700) with a CRS record, a COPC record and an extra dimension."""
    wkt = b'PROJCS["p",UNIT["metre",1]]\0'
    path.mkdir()
    for k, n in enumerate(counts):
        raw = bytearray(las_bytes(n, fmt, extra=[("mine", "<u8")], vlrs=[(b"LASF_Projection", 2112, wkt), (b"copc", 1, b"x")]))
        struct.pack_into("<6d", raw, 131, 0.01, 0.01, 0.01, 5e5 + 3 * k, 5.5e6, 700)
        (path / f"{'ab'[k]}.las").write_bytes(bytes(raw))
    return str(path)


def test_points_of_several_files_have_ids_of_their_own(spark, tmp_path):
    folder = folder_of_files(tmp_path / "in")
    for cloud in (las.read_points(spark, folder, 60), las.register(spark).read.format("las").option("range", 60).load(folder)):
        rows = cloud.orderBy("idx").collect()
        assert [r.idx for r in rows] == list(range(350)) and [r.record for r in rows] == [*range(200), *range(150)]
        assert (rows[201].x, rows[201].y) == pytest.approx((5e5 + 3.01, 5.5e6 + 0.02)) and rows[201].path.endswith("b.las")


@pytest.mark.parametrize("upgrade", [False, True])
def test_copies_keep_all_but_the_label(spark, tmp_path, upgrade):
    folder, out = folder_of_files(tmp_path / "in"), tmp_path / "out"
    cloud = checkpointed(las.read_points(spark, folder))
    code = F.expr(f"cast(record % {256 if upgrade else 32} as smallint)")
    for _ in range(2):  # a second run replaces the first
        las.write_copies(cloud.withColumn("classification", code), str(out), upgrade=upgrade, provenance="{}")
    assert sorted(p.name for p in out.iterdir()) == ["_manifest.json", "a.las", "b.las"]
    back = las.read_points(spark, str(out)).orderBy("idx").collect()
    same = ["idx", "record", "x", "y", "z", "raw_x", "intensity", "gps_time", "red", "mine", "return_number", "withheld", "scan_angle_rank"]
    assert [[r[c] for c in same] for r in back] == [[r[c] for c in same] for r in cloud.orderBy("idx").collect()]
    assert all(r.classification == r.record % (256 if upgrade else 32) for r in back)
    old, new = las.read_header(f"{folder}/b.las"), las.read_header(str(out / "b.las"))
    assert (new.scales, new.offsets, new.count, new.point_format, new.version) == (old.scales, old.offsets, 150, 7 if upgrade else 3, (1, 4) if upgrade else old.version)
    assert [(u, r) for u, r, _ in new.vlrs] == [("LASF_Projection", 2112), ("LASF_Spec", 4), ("pointloom", 1)] and new.vlrs[0][2] == old.vlrs[0][2]
    assert new.low[0] == pytest.approx(5e5 + 3) and new.high[0] == pytest.approx(5e5 + 3 + 1.49)
    if not upgrade:
        with pytest.raises(Exception, match="does not fit in 5 bits"):
            las.write_copies(cloud.withColumn("classification", F.lit(40)), str(out))
        assert len(las.read_points(spark, str(out)).collect()) == 350


def test_large_sources_come_in_parts(spark, tmp_path):
    cloud = las.read_points(spark, folder_of_files(tmp_path / "in"))
    las.write_copies(cloud, str(tmp_path / "out"), part=80, suffix="_c")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.las")) == [f"{s}_c-0000{k}.las" for s, n in (("a", 3), ("b", 2)) for k in range(n)]
    back = las.read_points(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert [r.raw_x for r in back] == [r.raw_x for r in cloud.orderBy("idx").collect()]


def test_classify_files_end_to_end(spark, tmp_path):
    folder, out = folder_of_files(tmp_path / "in"), str(tmp_path / "out")
    classes = spark.createDataFrame([(1, 2, "ground"), (2, 64, "platform")], "model_id int, asprs_code int, name string")

    def by_side(xyz):
        assert len(xyz) <= 100
        return (xyz[:, 0] > 5e5 + 2).astype("i4") + 1

    report = labelling.classify_files(spark, folder, out, by_side, classes, target=25, buffer=0.1, model_name="m").collect()
    assert sorted((r.path[-5:], r.out.rsplit("/", 1)[1], r.declared_count, r.n_out) for r in report) == [("a.las", "a_classified.las", 200, 200), ("b.las", "b_classified.las", 150, 150)]
    back = las.read_points(spark, out)
    assert back.count() == 350 and back.where("classification <> if(x > 500002, 64, 2)").count() == 0
    assert {r.point_format for r in las.scan_headers(spark, out).collect()} == {7}
    with pytest.raises(ValueError, match="over the budget"):
        labelling.classify_files(spark, folder, out, by_side, classes, target=25, buffer=50.0)
    (tmp_path / "in" / "c.las").write_bytes(b"no las")
    with pytest.raises(ValueError, match="no LAS file"):
        labelling.classify_files(spark, folder, out, by_side, classes)


def test_repeated_ids_fail(spark):
    cloud = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.1, 0.0, 0.0)], "idx long, x double, y double, z double")
    classes = spark.createDataFrame([(1, 2)], "model_id int, asprs_code int")
    with pytest.raises(Exception, match="several points have idx 1"):
        labelling.classify(cloud, lambda xyz: np.ones(len(xyz), int), classes).collect()


def test_write_las_far_from_the_origin(spark, tmp_path):
    cloud = spark.range(300).select(F.col("id").alias("idx"), (5e5 + F.col("id") / 8).alias("x"), (5.5e6 - F.col("id") / 4).alias("y"), F.lit(700.125).alias("z"))
    out = str(tmp_path / "out")
    las.write_classified(cloud, out, "las", parts=2)
    rows = sorted((r.x, r.y, r.z) for r in spark.read.format("las").load(out).collect())
    assert np.allclose(rows, [(5e5 + i / 8, 5.5e6 - i / 4, 700.125) for i in range(300)], rtol=0, atol=1e-6)
    heads = las.scan_headers(spark, out).agg(F.min("min_x"), F.max("max_x"), F.min("min_y"), F.max("max_y")).first()
    assert np.allclose(heads, [5e5, 5e5 + 299 / 8, 5.5e6 - 299 / 4, 5.5e6], rtol=0, atol=1e-6)
    for value in ("5e6D", "double('NaN')"):
        wide = cloud.withColumn("x", F.expr(f"if(idx = 7, {value}, -x)"))
        with pytest.raises(Exception, match="does not fit in 32 bits"):
            las.write_classified(wide, str(tmp_path / "wide"), "las", parts=2)
        assert not list((tmp_path / "wide").glob("*.las"))
    las.write_classified(cloud.where("false"), str(tmp_path / "none"), "las", parts=2)


def test_folder_listing(spark, tmp_path):
    for name in ("b.LAS", "a.laz", "c.qgis-view.copc.laz", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.laz", "b.LAS"]


def test_tiles_are_written_by_their_size(spark, tmp_path):
    """A tile with most of all points is several tasks' work; small tiles are not cut up."""
    rows = spark.range(20_000).select(F.col("id").alias("idx"), *[F.lit(0.0).alias(c) for c in "xyz"], F.when(F.col("id") < 15_000, 7).otherwise(F.col("id") % 40 + 100).alias("tile_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_tiles(rows, str(tmp_path / "tiles"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.count() == 20_000 and back.where("tile_id = 7").count() == 15_000
    written = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "tiles").glob("tile_id=*")}
    assert written.pop("tile_id=7") >= 3 and len(written) == 40 and max(written.values()) <= 2


@pytest.mark.parametrize("path, want", [("/in/a.las", "/o/a_c.las"), ("/in/a.LAS", "/o/a_c.las"), ("/in/b.copc.laz", "/o/b_c.laz"), ("/in/x.y.laz", "/o/x.y_c.laz")])
def test_output_names(spark, path, want):
    assert spark.range(1).select(files.output_path(F.lit(path), "/o", "_c")).first()[0] == want


def test_waveforms_and_degrees_are_refused(spark):
    rows = spark.createDataFrame([("a", False, False), ("b", True, False)], "path string, waveforms boolean, angular boolean")
    with pytest.raises(Exception, match="waveform"):
        files.refuse_waveforms(rows).collect()
    assert files.refuse_waveforms(rows.where("path = 'a'")).count() == 1


CLASSES = [(1, 2, "ground"), (2, 6, "building")]


def sides():
    """A model; not a function of this module, which workers cannot import."""
    return lambda xyz: (xyz[:, 0] > 5e5 + 2).astype("i4") + 1


def provenance_of(path):
    return sorted(json.loads(data)["field"] for user, record, data in las.read_header(str(path)).vlrs if (user, record) == (las.PROVENANCE_USER, 1))


def test_label_fields_and_their_records_live_side_by_side(spark, tmp_path):
    """A field of its own, then the classification, then both again: each pass keeps what the others left."""
    folder = folder_of_files(tmp_path / "in")
    classes = spark.createDataFrame(CLASSES, "model_id int, asprs_code int, name string")
    first, second, third = (str(tmp_path / n) for n in "123")
    labelling.classify_files(spark, folder, first, sides(), classes, target=25, buffer=0.1, field="label", suffix="")
    labelling.classify_files(spark, first, second, sides(), classes, target=25, buffer=0.1, suffix="")
    labelling.classify_files(spark, second, third, lambda xyz: np.ones(len(xyz), int), classes, target=25, buffer=0.1, field="label", suffix="")
    assert [provenance_of(tmp_path / n / "a.las") for n in "123"] == [["label"], ["classification", "label"], ["classification", "label"]]
    for folder, label in ((second, "if(x > 500002, 2, 1)"), (third, "1")):
        back = las.read_points(spark, folder)
        assert back.schema["label"].dataType.simpleString() == "int"
        assert back.count() == 350 and back.where(f"label <> {label} or classification <> if(x > 500002, 6, 2)").count() == 0


def test_classify_replaces_a_column_where_it_stands(spark):
    cloud = spark.range(50).select(F.col("id").alias("idx"), F.lit("mine").alias("label"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(7).alias("_merged"))
    classes = spark.createDataFrame([(1, 2)], "model_id int, asprs_code int")
    one = lambda xyz: np.ones(len(xyz), int)
    for column in ("label", "classification"):
        found = labelling.classify(cloud, one, classes, column=column)
        assert found.columns == cloud.columns + ([column] if column not in cloud.columns else [])
        assert [tuple(r) for r in found.select(column, "_merged").distinct().collect()] == [(2, 7)]
    assert found.select("label").distinct().first()[0] == "mine"


@pytest.mark.parametrize("result, suffix, field, message", [("in", "", "classification", "an input"), ("out", "_c", "intensity", "standard dimension"), ("out", "_c", "MINE", "other capitals"), ("out", "_c", "record", "every read"), ("out", "_c", "big", "no unscaled")])
def test_runs_that_must_not_start(spark, tmp_path, result, suffix, field, message):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.las").write_bytes(las_bytes(20, extra=[("mine", "u1"), ("big", "<f8")]))
    before = (tmp_path / "in" / "a.las").read_bytes()
    classes = spark.createDataFrame(CLASSES, "model_id int, asprs_code int, name string")

    def never(xyz):
        raise AssertionError("a label was made")

    with pytest.raises(ValueError, match=message):
        labelling.classify_files(spark, str(tmp_path / "in"), str(tmp_path / result), never, classes, field=field, suffix=suffix)
    assert (tmp_path / "in" / "a.las").read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == ["in"]


def test_changed_inputs_stop_the_publication(spark, tmp_path):
    folder, source = folder_of_files(tmp_path / "in"), tmp_path / "in" / "b.las"
    classes = spark.createDataFrame(CLASSES, "model_id int, asprs_code int, name string")

    model = sides()

    def meddling(xyz):
        os.utime(source, (1, 1))
        return model(xyz)

    with pytest.raises(ValueError, match="b.las changed during the run"):
        labelling.classify_files(spark, folder, str(tmp_path / "out"), meddling, classes, target=25, buffer=0.1)
    assert list((tmp_path / "out").iterdir()) == []


def test_files_in_one_place_keep_their_own_budget(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(20):
        (tmp_path / "in" / f"{k:02}.las").write_bytes(las_bytes(50))
    classes = spark.createDataFrame(CLASSES, "model_id int, asprs_code int, name string")

    def alone(xyz):
        assert len(xyz) <= 100
        return np.ones(len(xyz), int)

    report = labelling.classify_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), alone, classes, target=100, budget=100, buffer=50.0).collect()
    assert len(report) == 20 and {r.n_out for r in report} == {50}


def test_dimensions_named_like_columns(spark, tmp_path):
    """Names that other columns have are led by extra_, and files get them back as they were."""
    extra = [("idx", "u1"), ("path", "<i2"), ("Classification", "u1"), ("X", "<i4"), ("raw_x", "<u2"), ("extra_idx", "u1"), ("_class", "u1"), ("label", "<i4")]
    (tmp_path / "in").mkdir()
    raw = bytearray(las_bytes(30))
    dtype = np.dtype(las.FORMATS[3] + [(f"+{i}", t) for i, (_, t) in enumerate(extra)])
    data = np.zeros(30, dtype)
    data["X"] = np.arange(30)
    for i in range(len(extra)):
        data[f"+{i}"] = i + 1
    described = b"".join(struct.pack("<2xBB32s4x72x24x24x32x", las._EXTRA.index(t) + 1, 0, n.encode()) for n, t in extra)
    record = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"") + described
    struct.pack_into("<IIBH", raw, 96, 227 + len(record), 1, 3, dtype.itemsize)
    (tmp_path / "in" / "a.las").write_bytes(bytes(raw[:227]) + record + data.tobytes())
    cloud = checkpointed(las.read_points(spark, str(tmp_path / "in")))
    assert len({c.lower() for c in cloud.columns}) == len(cloud.columns)
    renamed = ["extra_idx", "extra_path", "extra_Classification", "extra_X", "extra_raw_x", "extra_extra_idx", "_class", "label"]
    assert cloud.columns[-len(extra):] == renamed and list(cloud.select(*renamed).distinct().first()) == list(range(1, 9))
    las.write_copies(cloud, str(tmp_path / "out"))
    assert [e[0] for e in las.read_header(str(tmp_path / "out" / "a.las")).extra] == [n for n, _ in extra]
    assert las.read_points(spark, str(tmp_path / "out")).drop("path").exceptAll(cloud.drop("path")).count() == 0


def test_boxes_and_columns_leave_files_unopened(spark, tmp_path):
    """A file outside the box is broken beyond its header, and nobody notices."""
    folder = folder_of_files(tmp_path / "in")
    for name, x in (("a", 5e5), ("b", 5e5 + 3)):  # true bounds
        with open(f"{folder}/{name}.las", "r+b") as file:
            file.seek(179)
            file.write(struct.pack("<6d", x + 2, x, 5.6e6, 5.5e6, 701, 700))
    whole = checkpointed(las.read_points(spark, folder))
    far = bytearray(las_bytes(40, extra=[("mine", "<u8")])[:-7])
    struct.pack_into("<6d", far, 179, 99.0, 90.0, 99.0, 90.0, 1.0, 0.0)
    (tmp_path / "in" / "c.las").write_bytes(bytes(far))
    box = (5e5 + 1, 5e6, 5e5 + 4, 6e6)
    near = las.read_points(spark, folder, 60, box=box, columns=["x", "idx", "mine"])
    assert near.columns == ["idx", "x", "mine"]
    want = whole.where("x between 500001 and 500004").select("idx", "x", "mine")
    assert want.count() > 0 and near.exceptAll(want).count() == want.exceptAll(near).count() == 0
    with pytest.raises(Exception, match="ends before"):
        las.read_points(spark, folder).count()
    with pytest.raises(ValueError, match="no columns"):
        las.read_points(spark, folder, columns=["nothing"])


# --- publication ------------------------------------------------------------------


def staged(folder, **files):
    """A stage with files (name -> text); what ``publish`` takes."""
    hidden = folder / "_temporary-x"
    hidden.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (hidden / f"try-{name}.las").write_text(text)
    return str(folder), str(hidden), [(f"{n}.las", f"try-{n}.las", 1) for n in files]


def contents(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.is_file() and p.suffix == ".las"}


def test_two_attempts_of_a_task_do_not_meet(spark, tmp_path):
    """The second attempt starts, and dies, after the first has written; the first one's file is whole."""
    folder, out = folder_of_files(tmp_path / "in"), tmp_path / "out"
    cloud = checkpointed(las.read_points(spark, folder))
    writer = las.LasCopier(str(out), cloud.schema, False, "classification", "", las.PART, "")
    batches = cloud.where("path like '%a.las'").orderBy("record").toArrow().to_batches()
    winner = writer.write(iter(batches))

    def dying():
        yield batches[0].slice(0, 10)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        writer.write(dying())
    again = writer.write(iter(batches))  # a speculative twin that ends well, too late
    assert {f[0] for f in winner.files} == {f[0] for f in again.files} and {f[1] for f in winner.files}.isdisjoint(f[1] for f in again.files)
    writer.commit([winner])
    assert sorted(p.name for p in out.iterdir()) == ["_manifest.json", "a.las"]
    assert las.read_points(spark, str(out)).count() == 200 and publishing.manifest(str(out))["files"] == [{"name": "a.las", "points": 200}]


@pytest.mark.parametrize("failing", [0, 1, 2, 3, 4])
def test_a_failing_move_leaves_what_was_there(tmp_path, monkeypatch, failing):
    publishing.publish(*staged(tmp_path, a="old a", b="old b"), False)
    before, told = contents(tmp_path), publishing.manifest(str(tmp_path))
    moves = []

    class Failing:
        def __init__(self, where):
            self.where = where

        def __getattr__(self, name):
            return getattr(self.where, name)

        def move(self, a, b):
            if ".json" not in a and "_previous" not in a:
                moves.append(a)
                if len(moves) == failing + 1:
                    raise OSError("no")
            self.where.move(a, b)

    real = publishing.located
    monkeypatch.setattr(publishing, "located", lambda path: (Failing(real(path)[0]), real(path)[1]))
    with pytest.raises(OSError, match="no"):
        publishing.publish(*staged(tmp_path, a="new a", b="new b", c="new c"), False)
    assert contents(tmp_path) == before and publishing.manifest(str(tmp_path)) == told
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(("_publishing", "_previous"))]


@pytest.mark.parametrize("dying", range(1, 12))
def test_a_crash_is_settled_by_the_next_publication(tmp_path, monkeypatch, dying):
    """The driver dies at any step: after ``settle`` the folder has all of the old files, or all of the new."""
    publishing.publish(*staged(tmp_path, a="old a", b="old b"), False)
    old, new = contents(tmp_path), {"a.las": "new a", "b.las": "old b", "c.las": "new c"}
    steps = []

    class Dying:
        def __init__(self, where):
            self.where = where

        def __getattr__(self, name):
            if name in ("move", "delete_file", "delete_dir", "create_dir"):
                steps.append(name)
                if len(steps) >= dying:  # from here on nothing works, the undoing neither
                    raise KeyboardInterrupt
            return getattr(self.where, name)

    real = publishing.located
    monkeypatch.setattr(publishing, "located", lambda path: (Dying(real(path)[0]), real(path)[1]))
    try:
        publishing.publish(*staged(tmp_path, a="new a", c="new c"), False)
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(publishing, "located", real)
    publishing.settle(str(tmp_path))
    assert contents(tmp_path) in (old, new)
    assert (contents(tmp_path) == new) == ("c.las" in [f["name"] for f in publishing.manifest(str(tmp_path))["files"]])
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(("_publishing", "_previous"))] or dying == 1


# --- models -----------------------------------------------------------------------


def counted(folder):
    """A model that leaves a file behind for each time it is loaded, named after the worker."""

    class Counted:
        context_buffer_m = 0.5
        ready = False

        def load(self):
            self.ready = True
            open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(self, xyz):
            assert self.ready
            return (xyz[:, 0] % 2 < 1).astype("i4") + 1

    return Counted()


def test_a_worker_loads_a_model_once(spark, tmp_path):
    cloud = spark.range(4000).select(F.col("id").alias("idx"), (F.col("id") % 200).cast("double").alias("x"), F.expr("double(id div 200)").alias("y"), F.lit(0.0).alias("z"))
    classes = spark.createDataFrame([(1, 2), (2, 6)], "model_id int, asprs_code int")
    labelled = checkpointed(labelling.classify(cloud, counted(str(tmp_path)), classes, target=40))
    assert labelled.where("classification <> if(x % 2 < 1, 6, 2)").count() == 0
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))  # some hundred tiles, one load a worker


def test_the_model_says_how_far_it_looks(spark):
    seen = []
    for need, want in ((None, 0.5), (2.0, 2.0)):
        seen.append(models.need_of(counted(""), need) == want)
    assert all(seen) and models.need_of(sides()) is None


def test_files_of_many_sections_are_those_of_one(spark, tmp_path, monkeypatch):
    """Tasks sort and write sections of a file, however large it is; what comes out is the file as one task writes it."""
    n = 1000
    cloud = spark.range(n).select(F.expr("id * 7 % 1000").alias("idx"), *[F.expr(f"double(id * {k} % 331)").alias(c) for c, k in (("x", 3), ("y", 5), ("z", 11))], F.expr("cast(id % 9 as short)").alias("classification"))
    held = {}
    for size in (n, 90):
        monkeypatch.setattr(las, "SECTION", size)
        source, out = str(tmp_path / f"in{size}"), str(tmp_path / f"out{size}")
        las.write_classified(cloud, source, "las", parts=2)
        assert len(list(Path(source).glob("*.las"))) == 2 and sorted(p.name for p in Path(source).iterdir() if p.is_dir()) == []
        las.write_copies(las.read_points(spark, str(tmp_path / f"in{n}")).withColumn("label", F.col("classification").cast("int")), out, field="label", part=400, provenance="{}")
        assert not [p for p in Path(out).iterdir() if p.is_dir()]
        held[size] = [p.read_bytes() for p in sorted(Path(out).glob("*.las"))]
        back = las.read_points(spark, source)
        firsts = sorted(r.n for r in back.groupBy("path").agg(F.count("*").alias("n")).collect())
        assert sum(firsts) == n and firsts[0] > n // 4
        rows = {(r.x, r.y, r.z, r.classification) for r in back.collect()}
        assert len(rows) == len({(r.x, r.y, r.z, r.classification) for r in cloud.collect()})
    assert held[n] == held[90] and len(held[n]) == 4
