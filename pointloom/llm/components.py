"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(low, F.col("u") == F.col("hub"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of those."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub")
    moved = edges.join(low, F.col("u") == F.col("hub")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(F.col("hub").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges between long ids -> (node, component), component the smallest id reached.

    Only nodes other than their component's smallest have a row. Every round
    is joins and aggregations over the edges; the driver sees two numbers of
    it. Loops and repeats do no harm; no edges give no rows. A hub's rows meet
    its minimum in a plain join, which adaptive execution splits.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        edges = checkpointed(_small_star(checkpointed(_large_star(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
