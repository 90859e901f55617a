"""Line deduplication by document counts.

Lines are exploded with their positions, normalised (white space of
``SPACES`` stripped at both ends, A-Z lower-cased) and hashed; a key of at least
``min_chars`` code points that stands in at least ``min_docs`` documents loses all
its lines except those in the largest doc_id that holds it. What is left of a
document is put together again by position, joined by newlines.

Only digests travel, stored once: (digest, doc_id) pairs are made distinct and counted with
partial sums, so a line of every document costs no task more than others.
Frequent digests meet their lines in two ways: at most ``HOT`` of them hold more
than one part in ``HOT`` of all counted pairs each, which bounds what is
broadcast; no other digest is heavier than that, and those join by shuffle.

Defined cases: a null or empty text is one empty line; a text that loses every
line becomes empty; a null text stays null; a row without a doc_id is left as it
is and counts for nothing; rows that repeat a doc_id are one document for the
counts, and each of them keeps or loses lines alike; repeated lines inside one
document count once and share their fate; an empty table gives an empty result;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, documents, fresh, narrow

#: Fewest code points of a key, and documents that hold it, for its lines to go.
MIN_CHARS, MIN_DOCS = 40, 5
#: Most digests that are broadcast.
HOT = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, pos, digest) of each line whose key is long enough. No shuffle."""
    rows = narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null")
    lines = rows.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_key", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_chars)
    whole = F.unhex(F.sha2(F.translate("key", _UPPER, _LOWER).cast("binary"), 256))
    return keys.select("doc_id", "text_key", "pos", F.substring(whole, 1, 16).alias("digest"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(digest, n_docs, keep_id) of those of ``lines`` (``line_digests``) that at least ``min_docs`` documents hold."""
    pairs = lines.select("digest", "doc_id").distinct()
    return pairs.groupBy("digest").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id")).where(F.col("n_docs") >= min_docs)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, dropped): ascending positions of the lines that go, of each text that loses any."""
    lines = checkpointed(line_digests(docs, min_chars, id_col, text_col))  # some 50 bytes a line; texts are cut and hashed once
    found = checkpointed(frequent_lines(lines, min_docs).withColumnRenamed("digest", "known"))
    total = found.agg(F.sum("n_docs")).first()[0] or 0
    heavy = F.col("n_docs") * HOT > total
    hot = lines.join(F.broadcast(found.where(heavy)), F.col("digest") == F.col("known"))
    rest = lines.join(found.where(~heavy), F.col("digest") == F.col("known"))
    gone = hot.unionByName(rest).where("doc_id <> keep_id")
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def drop_frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that go; same rows and columns.

    ``dropped_col`` names an added column with the positions of the dropped
    lines, ascending (empty where nothing went).
    """
    key, name, known_id, known_key = fresh(docs, "text_key"), fresh(docs, dropped_col or "dropped"), fresh(docs, "known_id"), fresh(docs, "known_key")
    gone = dropped_positions(docs, min_chars, min_docs, id_col, text_col)
    gone = gone.select(F.col("doc_id").alias(known_id), F.col("text_key").alias(known_key), F.col("dropped").alias(name))
    marked = docs.withColumn(key, _text_key(docs[text_col]))
    joined = marked.join(gone, (F.col(id_col) == F.col(known_id)) & (F.col(key) == F.col(known_key)), "left").drop(key, known_id, known_key)
    lines, size = lines_of(F.col(text_col)), F.size(name)
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(name), i - 1) + 1)
    until = lambda i: F.when(i == size, F.size(lines)).otherwise(F.get(F.col(name), i))
    # the lines between two dropped ones at a time: linear however many go
    stretches = F.transform(F.sequence(F.lit(0), size), lambda i: F.slice(lines, after(i) + 1, until(i) - after(i)))
    left = F.array_join(F.flatten(stretches), "\n")
    out = joined.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(left))
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<int>"))) if dropped_col else out.select(*docs.columns)


def op13_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = drop_frequent_lines(docs.withColumn("n_lines", F.size(lines_of(F.col("text"))).cast("long")), dropped_col="dropped")
    return kept.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), judged AS (
    SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep_id AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
