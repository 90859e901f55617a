"""Ranked lexical search over document intervals with range-maximum tables.

Documents are dealt to shards; a shard has, for each term, the posting list in
the order of doc_id with each posting's impact (its exact part of the score) and
a sparse table that names the largest impact of any stretch of the list in two
look-ups. A query starts with one interval, all documents of the shard. The sum
over its terms of the largest impact inside an interval bounds every score in
it. Intervals are taken best first, some at a time: each is split at the
document of its largest single impact, which is scored exactly, and the two
intervals beside that document get bounds of their own. An interval that cannot
reach the ten best so far is left, so results are exact.

Items are dealt to blocks of about ``TERMS`` terms, which bounds the vocabulary
and the frequencies that tasks get by broadcast; each block is a job of its own
over all documents. A document is read once a block, to the counts of its terms
that the block asks for; these are stored, their frequencies summed, and
searched where they lie, without a shuffle: a task builds shards of about
``POSTINGS`` postings one after another and carries its ten best on, and only ten rows
a task and item meet in the final ranking.

Defined cases: null and empty texts have no terms; an item without terms has no
results; equal items (id and text) are one, items that share an id but not the
text are ranked each by itself; documents without an id count and are found,
after all others of the same score; rows that repeat a doc_id are documents
each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import running_total
from .common import checkpointed, documents, map_batches, narrow

#: Results of an item.
TOP = 10
#: Terms of a block of items, as long as no single item has more; it bounds what is broadcast.
TERMS = 200_000
#: Postings of a shard, as long as no single document has more; it bounds a task's tables.
POSTINGS = 1 << 20
#: Intervals split at a time: at first, and at most.
FEW, MANY = 16, 512

# bytes that no term has become blanks, A-Z become a-z; bytes of other characters stay
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def counts_of(text: bytes) -> tuple[int, Counter]:
    """Number of terms, and how often each occurs."""
    counts = Counter(terms_of(text))
    return counts.total(), counts


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def item_blocks(items: DataFrame, terms: int = TERMS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_row, item_id, terms, block) of each different item with terms."""
    rows = narrow(items, item_id=id_col, text=text_col).where("text is not null").distinct()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(counts_of(t)[1]) for t in _bytes_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

        return step

    kind = rows.schema["item_id"].dataType.simpleString()
    found = map_batches(rows, make, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    stored = checkpointed(found.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "terms", F.size("terms").alias("size")))
    placed = running_total(stored, ["item_row"], "size", "upto")
    return checkpointed(placed.select("item_row", "item_id", "terms", F.expr(f"(upto - size) div {terms}").alias("block")))


def postings_of(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): of each document with terms, how many, and those that ``vocabulary`` numbers. No shuffle."""
    rows = narrow(docs, doc_id=id_col, text=text_col).where("text is not null")
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = known.value.get

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids, counts, ends = [], [], [], [0]
            for text in _bytes_of(batch.column(1)):
                n, found = counts_of(text)
                sizes.append(n)
                for term, count in found.items():
                    if (k := number(term)) is not None:
                        ids.append(k)
                        counts.append(count)
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (ids, counts)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, n long, terms array<int>, counts array<int>").where("n > 0")


def weight_of(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


class Best:
    """The best ``top`` of what was offered, as (-score, has no id, id)."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def floor(self) -> tuple[int, tuple | None]:
        """The score to reach, and the id to be under at that score; any score above 0 while places are free."""
        return (-self.rows[-1][0], self.rows[-1][1:]) if len(self.rows) == self.top else (0, None)

    def offer(self, score: int, key: tuple) -> None:
        insort(self.rows, (-score, *key))
        del self.rows[self.top :]


class Shard:
    """Posting lists of some documents, one after another, with impacts and range-maximum tables."""

    def __init__(self, ids: list, sizes: np.ndarray, per_doc: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.keys = [(ids[i] is None, ids[i] if ids[i] is not None else 0) for i in by_id]
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        doc = np.repeat(place, per_doc)
        self.keyed = terms.astype(np.int64) * len(ids) + doc
        order = np.argsort(self.keyed)
        self.keyed, self.doc = self.keyed[order], doc[order]
        length = 10 + (90 * sizes * n_docs) // n_terms
        tf, m = counts.astype(np.int64), np.repeat(length, per_doc)
        self.impact = (weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)))[order]
        self.starts = np.searchsorted(self.keyed, np.arange(len(weights) + 1) * len(ids))
        longest = int(np.diff(self.starts).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        self.log[1:] = np.log2(np.arange(1, longest + 1)).astype(np.int64)
        # tables[k][i]: where the largest impact of i .. i + 2**k - 1 is, the first of equals
        tables = [np.arange(len(order), dtype=np.int32)]
        for k in range(int(self.log[-1])):
            left, right = tables[-1][: -(1 << k)], tables[-1][1 << k :]
            wider = tables[-1].copy()
            wider[: len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            tables.append(wider)
        self.tables = np.stack(tables)

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For stretches lo .. hi - 1 (a column a term): the sum of their largest impacts, and the document of the largest of all."""
        some = hi > lo
        k = self.log[np.where(some, hi - lo, 1)]
        left, right = self.tables[k, np.where(some, lo, 0)], self.tables[k, np.where(some, hi - (1 << k), 0)]
        a, b = self.impact[left], self.impact[right]
        value = np.where(some, np.maximum(a, b), 0)
        at, row = value.argmax(1), np.arange(len(value))
        return value.sum(1), self.doc[np.where(a >= b, left, right)[row, at]]

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Offers every document of the shard that belongs among the best; returns how many were scored."""
        terms = terms[self.starts[terms + 1] > self.starts[terms]]
        if not len(terms):
            return 0
        lo, hi = self.starts[terms][None], self.starts[terms + 1][None]
        first = np.zeros(1, np.int64)
        bound, split = self.largest(lo, hi)
        batch, scored, base = FEW, 0, terms.astype(np.int64) * len(self.keys)
        while True:
            floor, under = best.floor()
            limit = bisect_left(self.keys, under) if under else 0
            alive = (bound > floor) | ((bound == floor) & (first < limit))
            if not alive.all():
                first, lo, hi, bound, split = first[alive], lo[alive], hi[alive], bound[alive], split[alive]
            if not len(bound):
                return scored
            if len(bound) > batch:
                order = np.argpartition(-bound, batch)
                now, later = order[:batch], order[batch:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            batch = min(2 * batch, MANY)
            at, a, b = split[now], lo[now], hi[now]
            p = np.searchsorted(self.keyed, base + at[:, None])
            q = np.minimum(p, len(self.doc) - 1)
            has = (p < b) & (self.doc[q] == at[:, None])
            score = np.where(has, self.impact[q], 0).sum(1)
            scored += len(now)
            for i in np.flatnonzero(score >= max(floor, 1)):
                best.offer(int(score[i]), self.keys[at[i]])
            child_lo, child_hi = np.concatenate([a, p + has]), np.concatenate([p, b])
            child_first = np.concatenate([first[now], at + 1])
            kept = (child_hi > child_lo).any(1)
            child_lo, child_hi, child_first = child_lo[kept], child_hi[kept], child_first[kept]
            more, places = self.largest(child_lo, child_hi)
            first, lo, hi = np.concatenate([first[later], child_first]), np.concatenate([lo[later], child_lo]), np.concatenate([hi[later], child_hi])
            bound, split = np.concatenate([bound[later], more]), np.concatenate([split[later], places])


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int, postings: int) -> Iterator[Shard]:
    """Shards of at most ``postings`` postings (or one document), cut from a task's rows."""
    held, size = [], 0

    def built():
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
        per_doc = np.diff(lists[0].offsets.to_numpy())
        return Shard(table.column("doc_id").to_pylist(), table.column("n").to_numpy(), per_doc, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), weights, n_docs, n_terms)

    for batch in batches:
        at = 0
        ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            until = int(np.searchsorted(ends, done + postings - size, "right"))
            until = until if held else max(until, at + 1)
            if until > at:
                held.append(batch.slice(at, until - at))
                size += int(ends[until - 1]) - done
                at = until
            if at < batch.num_rows:
                yield built()
                held, size = [], 0
    if held:
        yield built()


def _search_block(docs: DataFrame, rows: list, top: int, postings: int, id_col: str, text_col: str) -> DataFrame:
    """(item_row, doc_id, score): the best of each task for each item of a block."""
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    stored = checkpointed(postings_of(docs, vocabulary, id_col, text_col))
    row = stored.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    n_docs, n_terms = row.n_docs, row.n_terms or 1
    weights = np.zeros(len(vocabulary), np.int64)
    for r in stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # at most the block's vocabulary
        weights[r.term] = weight_of(n_docs, r.df)
    queries = [(r.item_row, np.array([vocabulary[bytes(t)] for t in r.terms], np.int64)) for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast((weights, queries))

    def run(batches):
        weights, queries = shared.value
        best = [Best(top) for _ in queries]
        kind = None

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        for shard in _shards(seen(), weights, n_docs, n_terms, postings):
            for (_, terms), found in zip(queries, best, strict=True):
                shard.search(terms, found)
        out = [(q[0], None if key[0] else key[1], -minus) for q, found in zip(queries, best, strict=True) for minus, *key in found.rows]
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), kind, pa.int64()], strict=True)], ["item_row", "doc_id", "score"])

    return stored.mapInArrow(run, f"item_row long, doc_id {stored.schema['doc_id'].dataType.simpleString()}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, terms: int = TERMS, postings: int = POSTINGS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents of a score above 0, equal scores by ascending doc_id."""
    blocks = item_blocks(items, terms, item_col, item_text_col)
    count = blocks.agg(F.max("block")).first()[0]
    found = None
    for block in range(count + 1 if count is not None else 0):
        rows = blocks.where(F.col("block") == block).collect()  # at most ``terms`` terms and one item's
        part = _search_block(docs, rows, top, postings, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    order = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranks.join(blocks.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")


def op11_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = rf"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
