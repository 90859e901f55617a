"""Classification codes, point formats, output code settings and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASPRS LAS 1.4 R15 standard classes 0 to 22, fixed values.
ASPRS_NAMES = (
    "Created, never classified", "Unclassified", "Ground", "Low vegetation", "Medium vegetation", "High vegetation", "Building", "Low point (noise)",
    "Reserved", "Water", "Rail", "Road surface", "Reserved", "Wire guard (shield)", "Wire conductor (phase)", "Transmission tower",
    "Wire-structure connector (insulator)", "Bridge deck", "High noise", "Overhead structure", "Ignored ground", "Snow", "Temporal exclusion",
)


def asprs_name(code: Column) -> Column:
    """Name of a code 0..255; another value fails the job, null stays null."""
    named = F.get(F.array(*[F.lit(n) for n in ASPRS_NAMES]), code.cast("int"))
    return (
        F.when(code.isNull(), F.lit(None).cast("string"))
        .when(code.between(0, 22), named)
        .when(code.between(23, 63), "Reserved")
        .when(code.between(64, 255), "User definable")
        .otherwise(F.raise_error(F.concat(code.cast("string"), F.lit(" is no LAS classification code"))).cast("string"))
    )


#: Formats with a 5-bit class field and their successors, fixed values.
UPGRADES = {0: 6, 1: 6, 2: 7, 3: 7, 4: 9, 5: 10}


def point_format_upgrade(fmt: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in UPGRADES.items() for v in pair])
    return F.coalesce(table[fmt], fmt).cast("int")


def scan_angle(rank: Column) -> Column:
    """Legacy whole degrees in steps of 0.006 degrees, halves to even."""
    return F.rint(rank.cast("double") / F.lit(0.006)).cast("short")


def upgrade_schema(points: DataFrame, keep_rank: bool = True) -> DataFrame:
    """Points of an old format with the 8-bit class field: scan_angle_rank becomes scan_angle, point_format its successor."""
    out = points
    if "scan_angle_rank" in points.columns:
        out = out.withColumn("scan_angle", scan_angle(F.col("scan_angle_rank")))
        if not keep_rank:
            out = out.drop("scan_angle_rank")
    if "point_format" in points.columns:
        out = out.withColumn("point_format", point_format_upgrade(F.col("point_format")))
    return out


def strip_records(files: DataFrame, user_id: str) -> DataFrame:
    """``files`` whose vlrs array lacks the records of ``user_id`` (case ignored)."""
    return files.withColumn("vlrs", F.filter("vlrs", lambda v: F.lower(v["user_id"]) != F.lit(user_id.lower())))


def parse_output_codes(settings: DataFrame, classes: DataFrame) -> DataFrame:
    """(setting_id, codes JSON) -> (setting_id, model_id, code, error).

    One row for each class: its code in the JSON object, or its default. A
    setting that breaks a rule gives one row with the error alone: not an
    object; keys that are not plain whole numbers, repeated or unknown; codes
    that are not whole numbers from 0 to 255. Blank text sets nothing. Keys
    are read from the text as well, since parsing keeps the last of repeats.
    """
    text = F.trim(F.coalesce("codes", F.lit("")))
    entry = r'"([^"\\]*)"\s*:\s*([^,{}\[\]"]+|"[^"\\]*"|\{[^}]*\}|\[[^\]]*\])'
    shape = r"^\{\s*(" + entry + r"\s*(,\s*" + entry + r"\s*)*)?\}$"
    keys = F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(entry), F.lit(1)))
    values = F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.regexp_extract_all(text, F.lit(entry), F.lit(2)), lambda v: F.trim(v)))
    known = classes.agg(F.collect_set(F.col("model_id").cast("string")).alias("known"))  # at most 256 classes
    read = settings.select("setting_id", text.alias("text"), keys.alias("keys"), values.alias("values")).crossJoin(F.broadcast(known))
    error = (
        F.when((F.col("text") != "") & ~F.col("text").rlike(shape), "not a JSON object of codes")
        .when(F.exists("keys", lambda k: ~k.rlike(r"^(0|[1-9][0-9]*)$")), "keys must be plain whole numbers")
        .when(F.size(F.array_distinct("keys")) < F.size("keys"), "repeated class id")
        .when(F.size(F.array_except("keys", "known")) > 0, "unknown class id")
        .when(F.exists("values", lambda v: ~v.rlike(r"^(0|[1-9][0-9]{0,2})$") | (v.try_cast("int") > 255)), "codes must be whole numbers from 0 to 255")
    )
    checked = read.withColumn("error", error)
    good = checked.where("error is null").crossJoin(F.broadcast(classes.select("model_id", "asprs_code")))
    at = F.array_position(F.col("keys"), F.col("model_id").cast("string")).cast("int")
    code = F.when(at > 0, F.try_element_at(F.col("values"), at).try_cast("int")).otherwise(F.col("asprs_code")).cast("int")
    rows = good.select("setting_id", F.col("model_id").cast("int").alias("model_id"), code.alias("code"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(checked.where("error is not null").select("setting_id", F.lit(None).cast("int").alias("model_id"), F.lit(None).cast("int").alias("code"), "error"))


def output_codes_json(classes: DataFrame) -> DataFrame:
    """One row: codes, the complete table as a JSON object with its keys in string order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("model_id").cast("string").alias("key"), F.col("asprs_code").alias("value"))))
    return classes.agg(F.to_json(F.map_from_entries(pairs)).alias("codes"))


def provenance_json(model: Column, weights: Column, field: Column, classes: Column) -> Column:
    """JSON of what labelled a field; ``classes``: array of struct(id, name, asprs)."""
    encoding = F.when(field == "classification", "ASPRS").otherwise("raw_model_ids")
    table = F.map_from_entries(F.transform(classes, lambda c: F.struct(c["id"].cast("string"), F.struct(c["name"].alias("name"), c["asprs"].alias("asprs")))))
    return F.to_json(F.struct(model.alias("model"), weights.alias("weights_sha256"), field.alias("field"), encoding.alias("encoding"), table.alias("classes")))


def provenance_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, field, ts, record): the newest record of each file and field; of equal times the larger record."""
    return old.unionByName(new).groupBy("file_id", "field").agg(F.max(F.struct("ts", "record")).alias("m")).select("file_id", "field", "m.ts", "m.record")


def softmax(values: Column) -> Column:
    """exp of each value over their sum, shifted by the largest."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: v / total)


#: Names of all standard dimensions, in lower case, fixed values.
STANDARD_DIMENSIONS = (
    "x", "y", "z", "intensity", "return_number", "number_of_returns", "scan_direction_flag", "edge_of_flight_line", "classification",
    "synthetic", "key_point", "withheld", "overlap", "scanner_channel", "scan_angle_rank", "scan_angle", "user_data", "point_source_id",
    "gps_time", "red", "green", "blue", "nir", "wavepacket_index", "wavepacket_offset", "wavepacket_size", "return_point_wave_location",
    "x_t", "y_t", "z_t",
)


def audit_label_field(dims: DataFrame, name: str | None) -> DataFrame:
    """(file_id, field, error) for a catalogue (file_id, dim, kind, n, scaled) of extra dimensions.

    kind is "i", "u", "f" ...; n the elements; scaled whether scales or
    offsets apply. "classification", in any case or by default, always fits.
    """
    wanted = (name or "classification").strip() or "classification"
    if wanted.lower() == "classification":
        return dims.select("file_id").distinct().select("file_id", F.lit("classification").alias("field"), F.lit(None).cast("string").alias("error"))
    same = F.lower(F.col("dim")) == wanted.lower()
    clash = F.coalesce(F.bool_or(same & (F.col("dim") != wanted)), F.lit(False))
    unfit = F.coalesce(F.bool_or(same & ((F.col("n") != 1) | ~F.col("kind").isin("i", "u") | F.col("scaled"))), F.lit(False))
    error = (
        F.when(F.lit("\0" in wanted or len(wanted.encode()) > 32), "name is longer than 32 bytes or holds NUL")
        .when(F.lit(wanted.lower() in STANDARD_DIMENSIONS), "name of a standard dimension")
        .when(clash, "exists with other capitals")
        .when(unfit, "exists and is no unscaled whole number")
    )
    return dims.groupBy("file_id").agg(error.alias("error")).select("file_id", F.lit(wanted).alias("field"), "error")


def register(spark) -> None:
    """The code functions as SQL functions: asprs_name, point_format_upgrade, scan_angle."""
    names = " ".join(f"when {k} then '{n}'" for k, n in enumerate(ASPRS_NAMES))
    spark.sql(f"create or replace temporary function asprs_name(code int) returns string return case code {names} else if(code between 23 and 63, 'Reserved', if(code between 64 and 255, 'User definable', raise_error('no LAS classification code'))) end")
    steps = " ".join(f"when {a} then {b}" for a, b in UPGRADES.items())
    spark.sql(f"create or replace temporary function point_format_upgrade(fmt int) returns int return case fmt {steps} else fmt end")
    spark.sql("create or replace temporary function scan_angle(rank int) returns smallint return cast(rint(rank / 0.006D) as smallint)")
