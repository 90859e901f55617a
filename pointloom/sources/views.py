"""Point clouds, files and class tables, as views over the driver's tables.

The SQL texts run unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PTS = """
select event_id as idx, value as x, cast(user_id as double) as y,
       cast(regexp_extract(props, '([0-9]+)', 1) as double) as z,
       case event_type when 'click' then 1 when 'view' then 2
            when 'purchase' then 3 when 'signup' then 4 else 5 end as model_id
from events
"""

PTS_BIG = """
select (cast(l_orderkey as bigint) * 10 + l_linenumber) * 100000000
         + cast(round(l_extendedprice * 100) as bigint) as idx,
       l_extendedprice / 100 as x, cast(l_partkey as double) as y, l_quantity as z,
       case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end as model_id
from lineitem
"""

#: {0}: the first index of an array, 0 in Spark and 1 in DuckDB.
VECS = """
select vec_id as idx, cast(embedding[{0}] as double) * 100 as x, cast(embedding[{1}] as double) * 100 as y,
       cast(embedding[{2}] as double) * 100 as z, label + 1 as model_id
from embeddings
"""

FILES = """
select s_suppkey as file_id,
       concat('/in/tile_', cast(s_suppkey as varchar(20)), case s_suppkey % 3 when 0 then '.las' when 1 then '.laz' else '.copc.laz' end) as path,
       s_suppkey * 10 + 5 as declared_count,
       abs(s_acctbal) / 100 as size_mb,
       case s_suppkey % 5 when 0 then 'metre' when 1 then 'US survey foot' when 2 then 'foot' when 3 then 'kilometre' else 'unknown' end as unit_name,
       case s_suppkey % 4 when 0 then 1 when 1 then 1 when 2 then 2 else null end as geo_1024,
       case s_suppkey % 4 when 0 then 2229 when 1 then 3812 when 2 then null else null end as geo_3072,
       case s_suppkey % 4 when 0 then 9003 when 1 then 9001 else null end as geo_3076,
       case s_suppkey % 8 when 1 then 5703 else null end as geo_4096,
       case s_suppkey % 4 when 0 then 9001 else null end as geo_4099,
       cast(s_suppkey % 11 as int) as point_format,
       case s_suppkey % 4 when 0 then 'auto' when 1 then 'metre' when 2 then 'foot' else 'us_foot' end as override
from supplier
"""

#: Fixed values: (model, id, name, ASPRS code, colour).
CLASS_ROWS = (
    ("airborne", 1, "ground", 2, "#a0522d"), ("airborne", 2, "vegetation", 5, "#228b22"), ("airborne", 3, "car", 1, "#808080"),
    ("airborne", 4, "truck", 1, "#696969"), ("airborne", 5, "power line", 14, "#ffd700"), ("airborne", 6, "fence", 1, "#a9a9a9"),
    ("airborne", 7, "pole", 15, "#ff8c00"), ("airborne", 8, "building", 6, "#b22222"),
    ("voxel", 1, "ground", 2, "#a0522d"), ("voxel", 2, "vegetation", 5, "#228b22"), ("voxel", 3, "vehicle", 1, "#808080"),
    ("voxel", 4, "power line", 14, "#ffd700"), ("voxel", 5, "fence", 1, "#a9a9a9"), ("voxel", 6, "pole", 15, "#ff8c00"), ("voxel", 7, "building", 6, "#b22222"),
    ("rail", 1, "ground", 2, "#a0522d"), ("rail", 2, "rail", 10, "#4682b4"), ("rail", 3, "pole", 15, "#ff8c00"),
    ("rail", 4, "wire", 14, "#ffd700"), ("rail", 5, "vegetation", 5, "#228b22"), ("rail", 6, "platform", 64, "#d2b48c"), ("rail", 7, "other", 1, "#808080"),
)

CLASSES = "select * from (values " + ", ".join(repr(r) for r in CLASS_ROWS) + ") as t(model, model_id, name, asprs_code, color)"


#: A class table made of the suppliers, at most 97 classes: ids unique, codes and names not.
OWN_CLASSES = """
select cast(s_suppkey % 97 as int) as model_id, concat('class ', cast(min(s_nationkey) as varchar(20))) as name,
       cast(min(s_suppkey) % 23 as int) as asprs_code, concat('#', cast(max(s_suppkey) % 1000 + 1000 as varchar(20))) as color
from supplier group by s_suppkey % 97
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The result of ``text`` with the driver's tables it names; nothing is registered for longer."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem", "embeddings", "supplier") if f"from {t}" in text}
    for name in tables:
        text = text.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(text, **tables)


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PTS.replace("{", "{{").replace("}", "}}"))


def pts_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PTS_BIG)


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VECS.format(0, 1, 2))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILES)


def classes(spark: SparkSession, model: str | None = None) -> DataFrame:
    found = spark.sql(CLASSES)
    return found.where(found.model == model).drop("model") if model else found
