"""Exact deduplication with a heavy-hitter split.

Texts are compared by SHA-256. Misra-Gries summaries, one a task, name every
digest that may hold more than a share of all rows; an exact count verifies
them. The winners are at most ``counters`` + 1 rows by the frequency bound, so
they are broadcast and their copies are settled map-side, however many there
are. All other digests, none of them frequent, go through one ordinary shuffle.

Defined cases: a null text counts as empty. Of equal texts the row with the
largest doc_id stays; a null doc_id ranks below every other. Rows that repeat
both text and doc_id count each in group_size, and one of them stays. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, fresh, narrow

#: Counters of a summary, and so the bound (plus one) on the rows broadcast.
COUNTERS = 1024


def digest_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def merge_counts(held: Counter, more: Counter, counters: int) -> Counter:
    """Misra-Gries merge: sum, then take the (counters + 1)-th largest count from all.

    Each result is at most the true count, and short of it by at most the
    rows seen divided by ``counters`` + 1.
    """
    held = held + more
    if len(held) > counters:
        cut = sorted(held.values(), reverse=True)[counters]
        held = Counter({k: n - cut for k, n in held.items() if n > cut})
    return held


def frequent(digests: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """Candidates (digest): all digests of at least 2 * total / (counters + 1) rows.

    Sums over the tasks' summaries never exceed true counts, so at most
    ``counters`` + 1 digests can reach the limit applied to them.
    """

    def summarise(batches):
        held: Counter = Counter()
        for batch in batches:
            held = merge_counts(held, Counter(batch.column(0).to_pylist()), counters)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    summaries = digests.select("digest").mapInArrow(summarise, "digest binary, n long")
    return summaries.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1.0, total / (counters + 1))).select("digest")


def exact_groups(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest (binary), keep_id, group_size, kept.

    The digests (about 50 bytes a row) are stored in the checkpoint folder;
    texts are read once and never shuffled.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    digests = checkpointed(rows.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("tag")))
    total = digests.count()
    limit = max(2.0, 2 * total / (counters + 1))
    last = F.max(F.struct("doc_id", "tag"))
    winners = checkpointed(
        digests.join(F.broadcast(frequent(digests, total, counters)), "digest")
        .groupBy("digest")
        .agg(last.alias("last"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= limit)
    )
    hot = digests.join(F.broadcast(winners), "digest").select("doc_id", "tag", "digest", "last", "group_size")
    others = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # stored, so that the join deals both sides anew and may split a digest of many rows
    groups = checkpointed(others.groupBy("digest").agg(last.alias("last"), F.count("*").alias("group_size")))
    cold = others.join(groups, "digest").select("doc_id", "tag", "digest", "last", "group_size")
    return hot.unionByName(cold).select("doc_id", "digest", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("last.tag")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they have.

    Texts are shuffled once at most, to meet their verdict.
    """
    groups = checkpointed(exact_groups(docs, counters, id_col, text_col))
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    name = fresh(docs, "text_digest")
    marked = docs.withColumn(name, digest_of(docs[text_col]))
    match = marked[name].eqNullSafe(kept.kept_digest) & marked[id_col].eqNullSafe(kept.kept_id)
    out = marked.join(kept, match, "left_semi")
    if groups.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():  # whole rows repeat
        out = out.dropDuplicates([id_col, name])
    return out.drop(name)


def op2_heavy_hitter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
