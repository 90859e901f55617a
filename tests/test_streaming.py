import pytest
from pyspark.sql import functions as F

from pointloom.streaming import arrivals


def write_part(spark, folder, first, n):
    spark.range(first, first + n).select(F.col("id").alias("idx"), F.expr("id % 2").alias("file_id")).coalesce(1).write.mode("append").parquet(folder)


def test_completeness_over_two_arrivals(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    files = spark.createDataFrame([(0, 10), (1, 10)], "file_id long, declared_count long")
    write_part(spark, source, 0, 10)
    schema = spark.read.parquet(source).schema

    def arrive():
        query = arrivals.stream_complete(arrivals.arrivals(spark, source, schema), files, target, state)
        query.awaitTermination()
        return query

    arrive()
    assert spark.read.schema("file_id long, n long, batch int").parquet(target).count() == 0
    write_part(spark, source, 10, 10)
    arrive()
    assert sorted(r.file_id for r in spark.read.parquet(target).collect()) == [0, 1]
    write_part(spark, source, 20, 2)
    with pytest.raises(Exception, match="more points"):
        arrive()
