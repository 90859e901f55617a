"""What operators need from the session: a shared folder, checkpoints, numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, made the checkpoint folder if none is.

    It is the session's ``spark.checkpoint.dir``. Where neither the session
    nor its context names one, a local session gets a temporary folder and a
    cluster an error, since executors would not share such a folder.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not known.isDefined():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
        known = context._jsc.sc().getCheckpointDir()
    return named or known.get()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without goes to the cluster's default file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored once in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def grown(df: DataFrame) -> DataFrame:
    """``df``, a side of a join that grows with the cloud: met by shuffle and merge, never broadcast.

    Spark plans broadcasts by estimates, which it takes from the sizes of
    compressed files and carries through stored results; the driver would have
    to hold many times as much.
    """
    return df.hint("merge")


#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df``, a side of a join with a row a file or the like: counted, and broadcast if small, else ``grown``."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else grown(df)


def numbered(df: DataFrame, buckets: list[Column], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` = 0, 1, 2, ... in the order of ``buckets``, then ``order``.

    Rows are numbered inside each bucket; only the buckets' counts, one row
    each, pass through a single task. Choose buckets that hold some thousands
    to millions of rows.
    """
    keys = [f"_bucket{k}" for k in range(len(buckets))]
    marked = df.withColumns(dict(zip(keys, buckets, strict=True)))
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return marked.withColumn("_place", within).join(starts, same).withColumn(name, F.col("_start") + F.col("_place") - 1).select(*df.columns, name)


def unused(df: DataFrame, name: str) -> str:
    """``name``, led by underscores until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name`` = 0, 1, 2, ... in the order of the columns ``order``.

    Rows are dealt by ranges whose bounds Spark samples from the columns
    themselves, so ranges are about equal however the values lie, and sorted
    in them. Only one row a range is summed up; the rank itself needs no
    further shuffle.
    """
    at, part = unused(df, "_at"), unused(df, "_part")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    runs = dealt.groupBy(F.col(part).alias("_r")).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = runs.select("_r", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(starts), F.col(part) == F.col("_r")).select(*df.columns, (F.col(at) + F.col("_shift")).alias(name))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to each row in the order of the distinct keys ``order``.

    Rows are dealt by ranges of the keys and summed inside them; only the
    ranges' totals, one row each, pass through a single task.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("_range").alias("_r")).agg(F.sum(value).alias("_sum")).select("_r", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_within", within).join(F.broadcast(starts), F.col("_range") == F.col("_r")).select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))
