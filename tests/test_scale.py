"""What lets the queries run on clouds many times as large."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom import catalog
from pointloom.catalog import QUERIES, SQL
from pointloom.operators import labels, neighbors
from pointloom.plans import labelling
from pointloom.sources import las, views

from conftest import rows_of

#: Queries over codes of 16 bits an axis.
CODED = ("batch_code", "hilbert", "patches", "serialize_z", "zorder", "zorder_roundtrip")


@pytest.fixture(scope="module")
def wide(spark, sf, tmp_path_factory):
    """The events with users beyond 16 bits."""
    at = str(tmp_path_factory.mktemp("wide"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.expr("user_id * 7919")).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", CODED)
def test_codes_of_clouds_beyond_16_bits(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet/*.parquet'")
    assert rows_of(QUERIES[name](spark, wide).toPandas()) == rows_of(con.sql(SQL[name]).df())


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cover_all_broadcasts_no_side_that_grows(spark, sf):
    plan = planned(QUERIES["cover_all"](spark, sf))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_stored_points_are_not_broadcast(spark, sf):
    """What is estimated of points read from LAS files are the few rows of their ranges."""
    stored = las.read_points(spark, catalog._stored(spark, sf, 1), columns=["idx", "x"])
    assert "BroadcastHashJoin" not in planned(spark.range(1 << 40).withColumnRenamed("id", "idx").join(stored, "idx"))


@pytest.mark.parametrize("name", ["block_last_wins", "block_or_merge"])
def test_blocks_are_no_groups_of_their_own(spark, sf, name):
    plan = planned(QUERIES[name](spark, sf))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_blocks_across_batches_meet_the_model_whole():
    seen = []

    def model(voxels):
        seen.append(voxels.tolist())
        return voxels.sum(1)

    rows = [(b, i, 0, b) for b, n in ((3, 1), (4, 7), (9, 2)) for i in range(n)]
    table = pa.table({n: np.array(v, np.int64) for n, v in zip(("block_id", "vi", "vj", "vk"), zip(*rows, strict=True), strict=True)})
    for size in (1, 2, 3, 100):
        seen.clear()
        found = [r for b in labelling._block_preds(model, table.to_batches(size)) for r in b.to_pylist()]
        assert [tuple(r.values()) for r in found] == [(*r, sum(r[1:])) for r in rows]
        assert [len(v) for v in seen] == [1, 7, 2]


def test_windows_are_cut_within_any_budget(spark, sf, monkeypatch):
    """A budget of the whole cloud asks for no window of it; one that no cut can bring down is kept as long as the budget allows it."""
    monkeypatch.setattr(labelling, "WINDOW", 300)
    cloud = views.pts(spark, sf)
    n, same = cloud.count(), spark.createDataFrame([(k, k, "") for k in range(256)], "model_id int, asprs_code int, name string")
    size = lambda xyz: np.full(len(xyz), len(xyz) // 10, np.int32)
    for by in ((), ("file",)):
        found = labelling.classify(cloud.withColumn("file", F.lit("a")), size, same, target=n, budget=n, need=5.0, by=by)
        seen = found.agg(F.max("classification"), F.count("*")).first()
        assert seen[0] <= 30 and seen[1] == n
    dense = cloud.withColumns({c: F.lit(1.0) for c in "xyz"})
    assert labelling.classify(dense, size, same, target=n, budget=n, need=5.0).agg(F.min("classification")).first()[0] == n // 10


def test_votes_of_crops_that_lie_together_are_summed_before_the_shuffle():
    rows = [(c, i) for c in (7, 2, 5) for i in range(4)]  # crops in the order of their places
    table = pa.table({"center": [c for c, _ in rows], "idx": [i for _, i in rows], **{a: [float(i) for _, i in rows] for a in "xyz"}})
    model = lambda xyz: np.stack([xyz[:, 2], xyz[:, 2] + 1], axis=1)
    found = [r for b in labelling._summed_votes(model, table.to_batches(3)) for r in b.to_pylist()]
    assert found == [{"idx": i, "probs": [3.0 * i, 3.0 * i + 3], "visits": 3} for i in range(4)]


def test_crops_that_nothing_cuts_are_not_ranked(spark, sf):
    """By their plan: sorted only where a search can find more than k, and no cloud joined again for places."""
    cloud = views.pts(spark, sf)
    assert neighbors.most_around(cloud, 36.0) >= 27
    at = cloud.select("idx").limit(3)
    for ranks in (True, False):
        found = neighbors.knn_crops(cloud, at, 10**6, 36.0, True, single=True, placed_too=True, ranks=ranks)
        assert ("Window" in planned(found)) is ranks and {*neighbors.PLACED} <= {*found.columns}
    placed = neighbors.placed_crops(cloud, 20, 6.0, 40.0).select("center", "idx")
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, neighbors.cover_all(cloud, 20, 6.0, 40.0).select("center", "idx").collect()))


@pytest.mark.parametrize("wide", [True, False])
def test_centres_go_to_few_cells_and_lose_no_point(spark, wide):
    """At most 8 cells a centre where they are wide, and every point at the radius itself."""
    rng = np.random.default_rng(5)
    at = [(int(i), *map(float, p)) for i, p in enumerate(np.concatenate([rng.integers(-30, 30, (400, 3)), [[0, 0, 0], [0, 0, 12_582_912]]]))]
    cloud = spark.createDataFrame(at, "idx long, x double, y double, z double")
    centers = cloud.withColumnRenamed("idx", "center")
    cells = neighbors.surroundings(centers.withColumn("_level", F.lit(0)), 6.0, wide).groupBy("center").count().agg(F.max("count")).first()[0]
    assert cells <= (8 if wide else 27)
    xyz = np.array([r[1:] for r in at])
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    found = neighbors.within_radius(cloud, centers, 6.0, wide=wide).select("center", "idx").collect()
    assert sorted(map(tuple, found)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(d2 <= 36)), strict=True))


def test_rounds_of_crops_shuffle_little(spark, sf, monkeypatch):
    """No cloud met again for points that share a place, no centre for where it lies."""
    sides, hinted = [], neighbors.grown
    monkeypatch.setattr(neighbors, "grown", lambda df: sides.append(df.count()) or hinted(df))
    cloud = views.pts(spark, sf)
    n = neighbors.placed_crops(cloud, 20, 6.0, 40.0).select("idx").distinct().count()
    assert n == cloud.count() and len(sides) == 3  # the first round's centres, and the points that each of two rounds has
    assert "Join" not in planned(neighbors.fill_centers(cloud.select("idx", *"xyz"), 20, 6.0, 0).select("idx", *"xyz"))


def test_votes_are_averaged_by_one_shuffle_of_arrays(spark):
    rows = [(i, [float(i + v), float(v), *[9.0] * (i % 2)], v + 1) for i in range(50) for v in range(3)]
    votes = spark.createDataFrame(rows, "idx long, probs array<double>, visits long")
    found = labels.ensemble_mean_arrays(votes)
    assert planned(found).count("hashpartitioning") == 1 and "Generate" not in planned(found)
    means = {i: [(3 * i + 3) / 6, 0.5, *[27 / 6] * (i % 2)] for i in range(50)}
    assert {r.idx: r.probs for r in found.collect()} == means
    table = pa.table({"idx": [r[0] for r in rows], "probs": [r[1] for r in rows], "visits": [r[2] for r in rows]})
    for size in (1, 2, 4, 1000):
        assert {r["idx"]: r["probs"] for b in labels._means(table.to_batches(size)) for r in b.to_pylist()} == means
    uneven = pa.table({"idx": [1, 1, 2], "probs": [[1.0], [3.0, 4.0], []], "visits": [1, 1, 1]})  # a class counts where it was voted on
    assert [r for b in labels._means(uneven.to_batches(2)) for r in b.to_pylist()] == [{"idx": 1, "probs": [2.0, 4.0]}]
