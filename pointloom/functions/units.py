"""Linear units of files: names, WKT, GeoTIFF keys, overrides."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few

METRE, FOOT, US_FOOT, KILOMETRE = 1.0, 0.3048, 1200.0 / 3937.0, 1000.0
#: EPSG unit codes, fixed values.
EPSG_UNITS = {9001: METRE, 9002: FOOT, 9003: US_FOOT, 9036: KILOMETRE}
OVERRIDES = {"metre": METRE, "foot": FOOT, "us_foot": US_FOOT}
LABELS = ((METRE, "metre", "metres"), (US_FOOT, "US survey foot", "US survey feet"), (FOOT, "foot", "international feet"), (KILOMETRE, "kilometre", "kilometres"))
#: WKT subtrees with units of their own, fixed values.
OTHER_UNITS = (
    "GEOGCS", "GEOGCRS", "GEODCRS", "GEODETICCRS", "BASEGEOGCRS", "BASEGEODCRS", "CONVERSION", "PROJECTION", "PARAMETER", "DATUM",
    "VERT_DATUM", "VDATUM", "TOWGS84", "PRIMEM", "SPHEROID", "ELLIPSOID", "ID", "AUTHORITY", "REMARK", "USAGE", "BBOX", "AREA", "SCOPE",
    "EXTENSION", "DERIVINGCONVERSION",
)
PROJECTED, LOCAL = ("PROJCS", "PROJCRS", "PROJECTEDCRS"), ("LOCAL_CS", "ENGCRS", "ENGINEERINGCRS")
VERTICAL, GEOGRAPHIC = ("VERT_CS", "VERTCRS", "VERTICALCRS"), ("GEOGCS", "GEOGCRS", "GEODCRS", "GEODETICCRS")

#: (whole name as a regular expression, metres), the first that fits; read alike by Python, Spark and SQL.
_FEET = "(.*(foot|feet).*|ft|ftus|us-ft|us_ft)"
NAME_RULES = ((f"(?=.*(us|survey)){_FEET}", US_FOOT), (_FEET, FOOT), (".*kilomet.*", KILOMETRE), (".*met.*", METRE))

UNITS = "struct<xy_to_m:double,z_to_m:double,angular:boolean,detected:boolean>"


def _named(factor: Column, column: int) -> Column:
    out = F.format_string("%s m unit" + ("s" if column == 2 else ""), factor.cast("string"))
    for row in reversed(LABELS):
        out = F.when(F.abs(factor - row[0]) < 1e-9, row[column]).otherwise(out)
    return F.when(factor.isNotNull(), out)


def unit_label(factor: Column) -> Column:
    return _named(factor, 1)


def unit_plural(factor: Column) -> Column:
    return _named(factor, 2)


def unit_from_name(name: Column) -> Column:
    """Metres a unit of that name, null if it is none known."""
    out = F.lit(None).cast("double")
    for rule, factor in reversed(NAME_RULES):
        out = F.when(name.rlike(_whole(rule)), F.lit(factor)).otherwise(out)
    return out


def _whole(rule: str) -> str:
    return f"(?is)^(?:{rule})$"


def to_metres(points: DataFrame, files: DataFrame, key: str = "file_id", kept: str | None = "raw_") -> DataFrame:
    """``points`` (file_id, x, y, z, ...) with x, y, z in metres by the file's factors (xy_to_m, z_to_m; null: 1); raw_x, raw_y, raw_z keep the source unless ``kept`` is None.

    The factors, one row a file, are broadcast while they are few.
    """
    factors = files.select(key, F.coalesce("xy_to_m", F.lit(1.0)).alias("_xy"), F.coalesce("z_to_m", F.lit(1.0)).alias("_z"))
    out = points.join(few(factors), key, "left")
    scaled = {c: F.col(c) * F.coalesce(F.col("_z" if c == "z" else "_xy"), F.lit(1.0)) for c in "xyz"}
    source = {f"{kept}{c}": F.col(c) for c in "xyz"} if kept else {}
    return out.withColumns(source | scaled).drop("_xy", "_z")


def _epsg(code: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in EPSG_UNITS.items() for v in pair])
    return table[code]


def units_from_geokeys(files: DataFrame, crs_units: DataFrame) -> DataFrame:
    """``files`` with geo (UNITS, or null where the keys say nothing) and geo_error.

    Keys are columns geo_1024, geo_3072, geo_3076, geo_4096, geo_4099;
    ``crs_units`` (code, to_m) gives the unit of CRS codes, each once.
    """
    user = lambda c: F.when(~F.col(c).isin(0, 32767), F.col(c))
    crs = crs_units.dropDuplicates(["code"])
    h, v = crs.select(F.col("code").alias("_h"), F.col("to_m").alias("_hm")), crs.select(F.col("code").alias("_v"), F.col("to_m").alias("_vm"))
    met = files.join(h, user("geo_3072") == F.col("_h"), "left").join(v, user("geo_4096") == F.col("_v"), "left")
    angular = (F.coalesce("geo_1024", F.lit(0)) == 2) & user("geo_3072").isNull()
    xy = F.coalesce(_epsg(F.col("geo_3076")), F.col("_hm"))
    z = F.coalesce(_epsg(F.col("geo_4099")), F.col("_vm"))
    lost = ~angular & xy.isNotNull() & z.isNull() & user("geo_4096").isNotNull()
    found = F.struct(xy.alias("xy_to_m"), F.coalesce(z, xy).alias("z_to_m"), F.lit(False).alias("angular"), F.lit(True).alias("detected"))
    degrees = F.struct(F.lit(1.0).alias("xy_to_m"), F.lit(1.0).alias("z_to_m"), F.lit(True).alias("angular"), F.lit(True).alias("detected"))
    geo = F.when(angular, degrees).when(xy.isNotNull() & ~lost, found)
    error = F.when(lost, F.concat(F.lit("cannot resolve the unit of vertical EPSG:"), F.col("geo_4096").cast("string")))
    return met.withColumns({"geo": geo.cast(UNITS), "geo_error": error}).drop("_h", "_hm", "_v", "_vm")


# --- WKT ---------------------------------------------------------------------------

_TOKEN = re.compile(r'"(?:[^"]|"")*"|[\[(]|[\])]|,|[^\[\](),"\s][^\[\](),"]*')


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", re.IGNORECASE)


def _node_factor(name: str, numbers: list[str]) -> float | None:
    """Metres of a unit node: its conversion if that is a positive number, else what the rules say of its name."""
    stated = float(numbers[0]) if numbers else 0.0
    if 0 < stated < math.inf:
        return stated
    return next((factor for rule, factor in NAME_RULES if re.search(_whole(rule), name)), None)


def wkt_units(wkt: str | None) -> tuple[float, float, bool] | None:
    """(xy, z, angular) of a WKT text, or None.

    One pass over the tokens with the stack of open keywords: a unit counts
    for the horizontal or the vertical system it lies in, the first each,
    unless a subtree with other units is open around it.
    """
    stack: list[tuple[str, list[str]]] = []
    before, closed, kinds, found = None, False, set(), {}
    for token in _TOKEN.findall(wkt or ""):
        if closed:
            break
        if token in "[(":
            if before is None or before[:1] == '"':
                return None
            stack.append((before.upper(), []))
            kinds.add(before.upper())
            before = None
        elif not stack:
            if before is not None or token in "])," or token[:1] == '"':
                return None
            before = token.strip()
        elif token in "])" or token == ",":
            if before is not None:
                stack[-1][1].append(before)
                before = None
            if token == ",":
                continue
            keyword, args = stack.pop()
            around = {k for k, _ in stack}
            if keyword in ("UNIT", "LENGTHUNIT") and not around.intersection(OTHER_UNITS):
                role = "z" if around.intersection(VERTICAL) else "xy" if around.intersection(PROJECTED) else "local" if around.intersection(LOCAL) else ""
                names = [a[1:-1].replace('""', '"') for a in args[:1] if a[:1] == '"']
                factor = _node_factor("".join(names), [a for a in args[1:] if _NUMBER.fullmatch(a)])
                if factor is not None:
                    found.setdefault(role, factor)
            closed = not stack
        else:
            before = token.strip()
    if not closed:
        return None
    if not kinds.intersection(PROJECTED + LOCAL):
        return (1.0, 1.0, True) if kinds.intersection(GEOGRAPHIC) else None
    xy = found.get("xy" if kinds.intersection(PROJECTED) else "local")
    return None if xy is None else (xy, found.get("z", xy), False)


def _read_wkt(wkt: pd.Series) -> pd.DataFrame:
    rows = [wkt_units(w) for w in wkt]
    columns = [[r and r[k] for r in rows] for k in range(3)]
    return pd.DataFrame(dict(zip(("xy_to_m", "z_to_m", "angular"), columns, strict=True)) | {"detected": [r and True for r in rows]})


def units_from_wkt(wkt: Column) -> Column:
    """UNITS of WKT strings (1 or 2), null where one cannot be read or has no linear unit; one row a file."""
    return F.pandas_udf(_read_wkt, "xy_to_m double, z_to_m double, angular boolean, detected boolean")(wkt)


def resolve_units(files: DataFrame, crs_units: DataFrame, wkt: str | None = "wkt") -> DataFrame:
    """``files`` with xy_to_m, z_to_m, angular, detected, conflict.

    Degrees always win; then the override (column override); then WKT,
    GeoTIFF keys, and metres (detected false). An override also repairs an
    unknown vertical unit, which otherwise fails the job. ``conflict`` says
    what an override overrides.
    """
    met = units_from_geokeys(files, crs_units)
    read = met.withColumn("_wkt", units_from_wkt(F.col(wkt)) if wkt else F.lit(None).cast(UNITS))
    by_wkt = F.col("_wkt.xy_to_m").isNotNull()
    metres = F.struct(F.lit(1.0).alias("xy_to_m"), F.lit(1.0).alias("z_to_m"), F.lit(False).alias("angular"), F.lit(False).alias("detected")).cast(UNITS)
    lost = ~by_wkt & F.col("geo_error").isNotNull()
    read = read.withColumn("_found", F.when(by_wkt, F.col("_wkt")).when(~lost, F.coalesce("geo", metres)))
    key = F.lower(F.trim(F.coalesce("override", F.lit("auto"))))
    forced = F.create_map(*[F.lit(v) for pair in OVERRIDES.items() for v in pair])[key]
    angular = F.coalesce("_found.angular", F.lit(False))
    error = F.raise_error(F.col("geo_error")).cast("double")
    pick = lambda c: F.when(angular, F.lit(1.0)).when(forced.isNotNull(), forced).when(lost, error).otherwise(F.col(f"_found.{c}"))
    differs = (F.abs(F.col("_found.xy_to_m") - forced) > 1e-9) | (F.abs(F.col("_found.z_to_m") - forced) > 1e-9)
    one = F.abs(F.col("_found.xy_to_m") - F.col("_found.z_to_m")) < 1e-9
    stated = F.when(one, unit_plural(F.col("_found.xy_to_m"))).otherwise(F.concat(unit_plural(F.col("_found.xy_to_m")), F.lit(" (XY) and "), unit_plural(F.col("_found.z_to_m")), F.lit(" (Z)")))
    conflict = F.when(~angular & forced.isNotNull() & F.col("_found.detected") & differs, F.concat(F.lit("the file says "), stated, F.lit(", the override "), unit_plural(forced)))
    return read.select(
        *files.columns, pick("xy_to_m").alias("xy_to_m"), pick("z_to_m").alias("z_to_m"), angular.alias("angular"),
        F.when(angular | forced.isNull(), F.coalesce("_found.detected", F.lit(False))).otherwise(True).alias("detected"), conflict.alias("conflict"),
    )


def register(spark) -> None:
    """SQL functions unit_from_name(name), unit_label(to_m) and unit_plural(to_m)."""
    names = " ".join(f"when name rlike '{_whole(rule)}' then {factor!r}D" for rule, factor in NAME_RULES)
    spark.sql(f"create or replace temporary function unit_from_name(name string) returns double return case {names} end")
    for function, column, ending in (("unit_label", 1, ""), ("unit_plural", 2, "s")):
        rules = " ".join(f"when abs(to_m - {row[0]!r}D) < 1e-9D then '{row[column]}'" for row in LABELS)
        spark.sql(f"create or replace temporary function {function}(to_m double) returns string return case {rules} when to_m is not null then concat(to_m, ' m unit{ending}') end")
