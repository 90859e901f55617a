"""Substring deduplication by hashing lines and their sentences.

Units are lines, cut further behind each sentence (an end mark, perhaps a
closing quote or bracket, then white space), because passages that are pasted
into a text seldom begin and end with a line. Units are normalised (ASCII
letters to lower case, runs of ASCII white space to one space, ends trimmed)
and hashed to 128 bits; digests are grouped over the whole corpus; the
occurrence with the smallest (doc_id, start) stays. Later occurrences of units
that several documents have, following one another without a gap, are a
passage, and a passage of at least ``min_words`` words goes. What is shorter ("All
rights reserved.", a sentence of three words) repeats in ordinary prose, and
what repeats inside one document alone is that document's own way; both are
listed by ``repeated_units`` like the rest, with ``removed`` false, and stay in
the text. Offsets count code points of the original text.

Defined cases: null and empty texts have no units; blank lines are no units; a
passage goes with the white space after it; a document without an id has no
rank, so it is left as it is and keeps nothing else out; rows that repeat both
doc_id and text are one document, each changed alike; one doc_id with
different texts is several documents, ranked by hash of the text; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, documents, fresh, map_batches, narrow, texts_of

#: Fewest words that a removed passage has.
MIN_WORDS = 20

#: Marks that end a sentence, and what may close it.
END_MARKS, CLOSERS = ".!?…。！？", "\"'”’»)]"
_CUT = re.compile(rf"[\n{END_MARKS}](?:(?<=\n)|(?<!\n)[{re.escape(CLOSERS)}]?(?=[{SPACES}]))")


def units_of(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """(start, end, next, words, digest) of each unit with words; ``next`` is where the following unit starts."""
    found, at = [], 0
    for cut in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        piece = text[at:cut]
        words = piece.encode().lower().split()
        if words:
            start = at + len(piece) - len(piece.lstrip(SPACES))
            found.append((start, at + len(piece.rstrip(SPACES)), len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()))
        at = cut
    starts = [u[0] for u in found[1:]] + [len(text)]
    return [(a, b, n, w, d) for (a, b, w, d), n in zip(found, starts, strict=False)]


def _text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


_UNIT = ("start", "end", "next", "n_words", "digest")
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def text_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, start, end, next, n_words, digest) of every unit. No shuffle."""
    rows = narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null")
    rows = rows.select("doc_id", _text_key(F.col("text")).alias("text_key"), "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            units = [units_of(t) for t in texts_of(batch.column(2))]
            back = pa.array([i for i, u in enumerate(units) for _ in u], pa.int64())
            columns = zip(*(x for u in units for x in u), strict=True) if len(back) else [[]] * len(_UNIT)
            flat = [pa.array(v, t) for v, t in zip(columns, _KINDS, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(back), batch.column(1).take(back), *flat], ["doc_id", "text_key", *_UNIT])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, text_key long, start int, end int, next int, n_words int, digest binary")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per later occurrence of a unit: doc_id, text_key, run, start, end, next, n_words, keep_id, keep_start, shared, removed.

    ``run`` is where the passage starts that the unit is part of; ``keep_id``
    and ``keep_start`` say where the unit stays, ``shared`` whether several
    documents have it. The units are read twice
    from the texts rather than stored: once to find the first place of each
    digest, aggregated before the shuffle, once to meet the digests that
    occur twice, in a plain join that adaptive execution splits where a line
    is very frequent.
    """
    units = text_units(docs, id_col, text_col)
    place = F.struct("doc_id", "text_key", "start")
    firsts = units.groupBy("digest").agg(F.min(place).alias("first"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("n > 1")
    # stored, so that the join deals both sides anew and may split a frequent digest
    firsts = checkpointed(firsts.select(F.col("digest").alias("first_digest"), "first", (F.col("first.doc_id") != F.col("last_id")).alias("shared")))
    later = units.join(firsts, F.col("digest") == F.col("first_digest")).where(place != F.col("first"))
    later = later.select("doc_id", "text_key", "start", "end", "next", "n_words", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"), "shared")
    document = Window.partitionBy("doc_id", "text_key").orderBy("start")
    # rows that repeat doc_id and text give equal rows, which count once
    single = later.withColumn("_again", F.lag("start").over(document)).where("_again is null or _again <> start").drop("_again")
    goes_on = F.lag("next").over(document).eqNullSafe(F.col("start")) & F.col("shared") & F.lag("shared").over(document)
    heads = single.withColumn("_head", F.when(goes_on, None).otherwise(F.col("start")))
    runs = heads.withColumn("run", F.last("_head", ignorenulls=True).over(document)).drop("_head")
    words = F.sum("n_words").over(Window.partitionBy("doc_id", "text_key", "run"))
    return runs.withColumn("removed", F.col("shared") & (words >= min_words))


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; same rows and columns.

    ``spans_col`` names an added column with the removed (start, end) of the
    original text, ascending (null where nothing went). Texts meet their
    spans in one join, which needs no shuffle of texts while the spans are few
    enough to be broadcast.
    """
    found = repeated_units(docs, min_words, id_col, text_col).where("removed")
    runs = found.groupBy("doc_id", "text_key", "run").agg(F.max("next").alias("end"))
    spans = runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct(F.col("run").alias("start"), "end"))).alias("found_spans"))
    key, name, found_id, found_key = fresh(docs, "text_key"), fresh(docs, spans_col or "removed_spans"), fresh(docs, "found_id"), fresh(docs, "found_key")
    spans = spans.select(F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key), F.col("found_spans").alias(name))
    marked = docs.withColumn(key, _text_key(docs[text_col]))
    joined = marked.join(spans, (F.col(id_col) == F.col(found_id)) & (F.col(key) == F.col(found_key)), "left").drop(found_id, found_key, key)
    size = F.size(name)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(name), i - 1)["end"])
    until = lambda i: F.when(i == size, F.length(text_col)).otherwise(F.get(F.col(name), i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(F.col(text_col), before(i) + 1, until(i) - before(i)))
    out = joined.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(F.array_join(pieces, "")))
    return out if spans_col else out.select(*docs.columns)


def op8_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that go, each with the place where it stays."""
    found = repeated_units(documents(spark, sf_dir)).where("removed")
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("run", "start", "end", "n_words")], "keep_id", F.col("keep_start").cast("long").alias("keep_start"))


_MARKS, _CLOSE = END_MARKS, CLOSERS.replace("'", "''").replace("]", r"\]")

OP8_SQL = rf"""
WITH pieces AS (
    SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, string_split(replace(regexp_replace(text, '([{_MARKS}][{_CLOSE}]?)([ \t\n\x0B\x0C\r])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS parts
          FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), placed AS (
    SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT - length(piece) AS base,
           translate(trim(regexp_replace(piece, '[ \t\n\x0B\x0C\r]+', ' ', 'g'), ' '),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM pieces
), units AS (
    SELECT doc_id, base + length(piece) - length(regexp_replace(piece, '^[ \t\n\x0B\x0C\r]+', '')) AS start,
           base + length(regexp_replace(piece, '[ \t\n\x0B\x0C\r]+$', '')) AS "end", len(string_split(norm, ' '))::BIGINT AS n_words, norm
    FROM placed WHERE norm <> ''
), followed AS (
    SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM units
), firsts AS (
    SELECT norm, min({{'doc_id': doc_id, 'start': start}}) AS first, min(doc_id) <> max(doc_id) AS shared FROM units GROUP BY norm HAVING count(*) > 1
), later AS (
    SELECT u.*, f.first.doc_id AS keep_id, f.first.start AS keep_start, f.shared
    FROM followed u JOIN firsts f USING (norm)
    WHERE u.doc_id <> f.first.doc_id OR u.start <> f.first.start
), heads AS (
    SELECT *, CASE WHEN lag(start) OVER (PARTITION BY doc_id ORDER BY start) IS NOT DISTINCT FROM prev AND prev IS NOT NULL AND shared AND lag(shared) OVER (PARTITION BY doc_id ORDER BY start) THEN NULL ELSE start END AS head FROM later
), runs AS (
    SELECT *, max(head) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM heads
), whole AS (
    SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS run_words FROM runs
)
SELECT doc_id, run, start, "end", n_words, keep_id, keep_start FROM whole WHERE shared AND run_words >= {MIN_WORDS}
"""
