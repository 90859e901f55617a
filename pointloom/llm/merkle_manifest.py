"""A Merkle manifest of a dataset, its proofs gathered by a butterfly exchange.

Leaves are digests of rows; the leaves of a source, in the order of doc_id,
make one tree of fanout 3, and the trees' roots, in the order of sources, make
the tree above. Leaves are dealt to aligned partitions of 3**HEIGHT. Each
partition hashes its own subtree. Then, round by round, groups of three
partitions whose numbers differ in one ternary digit swap the roots of the
subtrees that they stand in, and each of the three hashes the parent for itself.
After as many rounds as the number of partitions has digits, every partition has
its tree's root and all siblings on the way: nothing is passed down. Where the
last subtree of a round is short, its partitions answer for the missing ones, in
turns.

A round shuffles one small row a partition, so the rows themselves are never
moved again: leaves are ranked by ranges (only the ranges' counts are summed
up), which splits a source of any size, and gathered once. Both levels, leaves
in sources and sources in the dataset, are built by the same functions.

Defined cases: nulls hash as ``-``; a null source is a source of its own, first;
null doc_ids come first and are never tampered with; equal doc_ids of a source
are ordered by their leaves, and rows that repeat entirely are leaves each; a
lone leaf is its source's root, a lone source's root the root, and an empty list
of siblings hashes as the empty text; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, remainder_of_crc

FANOUT = 3
#: A partition holds FANOUT ** HEIGHT leaves.
HEIGHT = 5
#: Columns of a row that make its leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_TRAIL = "array<struct<place:int,others:array<string>>>"


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns: each ``-`` if null, else byte count, colon, value."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(digests: list[str], height: int | None = None) -> list[list[str]]:
    """The levels of a subtree from its leaves up: ``height`` of them above the leaves, or as many as lead to one node."""
    out = [digests]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest_of(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def trail_of(levels: list[list[str]], leaf: int) -> list[tuple[int, list[str]]]:
    """(place in the run, the run's others) of a leaf's ancestors, from the leaf up to below the top."""
    out = []
    for level in levels[:-1]:
        run = level[leaf - leaf % FANOUT : leaf - leaf % FANOUT + FANOUT]
        out.append((leaf % FANOUT, run[: leaf % FANOUT] + run[leaf % FANOUT + 1 :]))
        leaf //= FANOUT
    return out


def fold(digest: str, trail: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf leads to along a trail."""
    for place, others in trail:
        digest = digest_of([*others[:place], digest, *others[place:]])
    return digest


def _height(parts: int, height: int) -> int | None:
    return height if parts > 1 else None


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with pos, the rank in the tree by ``order``, and n, the tree's size.

    Rows are dealt by ranges and sorted in them; only one row a range and tree
    is summed up, per tree.
    """
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = checkpointed(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    runs = dealt.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")
    starts = runs.select(F.col("tree").alias("in_tree"), F.col("range").alias("in_range"), shift.alias("shift"), F.sum("size").over(whole).alias("n"))
    joined = dealt.join(starts, (F.col("tree") == F.col("in_tree")) & (F.col("range") == F.col("in_range")))
    return joined.select(*leaves.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def partitions_of(leaves: DataFrame, order: list[str], height: int = HEIGHT) -> DataFrame:
    """(tree, part, parts, members, node): aligned partitions with their leaves in order and the root of their subtree.

    ``leaves`` has tree, digest and columns that members carry along (none called pos, n, part or parts).
    """
    size = FANOUT**height
    at = ranked(leaves, order).withColumns({"part": F.expr(f"pos div {size}"), "parts": F.expr(f"(n + {size - 1}) div {size}")})
    member = F.struct("pos", *[c for c in leaves.columns if c != "tree"])
    gathered = at.groupBy("tree", "part", "parts").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, parts = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            nodes = [levels_of([m["digest"] for m in d], _height(n, height))[-1][0] for d, n in zip(digests, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.string())], [*batch.schema.names, "node"])

    return checkpointed(gathered.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in gathered.schema)}, node string"))


def butterfly_round(state: DataFrame, step: int) -> DataFrame:
    """``state`` (tree, part, parts, node, trail) one level up: nodes cover ``step`` partitions before, three times as many after."""
    last = F.expr(f"part div {step} = (parts - 1) div {step}")
    # the last subtree's partitions stand in for those it lacks, each for every so-manieth
    turns = F.sequence(F.col("offset"), F.lit(step - 1), F.expr(f"(parts - 1) % {step} + 1"))
    sent = state.withColumn("offset", F.expr(f"part % {step}"))
    sent = sent.select("*", F.posexplode(F.when(last, turns).otherwise(F.array("offset"))).alias("turn", "to"))
    own = F.col("turn") == 0
    message = F.struct(F.expr(f"part div {step} % {FANOUT}").alias("digit"), "node", F.when(own, F.col("part")).alias("part"), F.when(own, F.col("trail")).alias("trail"))
    met = sent.groupBy("tree", "parts", F.expr(f"part div {step * FANOUT}").alias("group"), "to").agg(F.array_sort(F.collect_list(message)).alias("all"))
    nodes = F.col("all.node")
    heard = met.select("tree", "parts", nodes.alias("nodes"), F.sha2(F.array_join(nodes, "").cast("binary"), 256).alias("parent"), F.posexplode("all").alias("place", "m"))
    others = F.filter("nodes", lambda _, i: i != F.col("place"))
    trail = F.concat("m.trail", F.array(F.struct("place", others.alias("others"))))
    return heard.where("m.part is not null").select("tree", F.col("m.part").alias("part"), "parts", F.col("parent").alias("node"), trail.alias("trail"))


def exchanged(partitions: DataFrame) -> DataFrame:
    """(tree, part, parts, node, trail): each partition with its tree's root, and the siblings from its subtree's root up."""
    state = partitions.select("tree", "part", "parts", "node", F.lit(None).cast(_TRAIL).alias("trail"))
    state = state.withColumn("trail", F.coalesce("trail", F.array().cast(_TRAIL)))
    most, step, done = partitions.agg(F.max("parts")).first()[0] or 1, 1, state.where("parts <= 1")
    while step < most:
        state = checkpointed(butterfly_round(state.where(F.col("parts") > step), step))
        step *= FANOUT
        done = done.unionByName(state.where(F.col("parts") <= step))
    return done


def _trails(row_members: list[dict], parts: int, upper: list[dict], height: int) -> Iterator[tuple[dict, list]]:
    levels = levels_of([m["digest"] for m in row_members], _height(parts, height))
    above = [(t["place"], t["others"]) for t in upper]
    for k, member in enumerate(row_members):
        yield member, trail_of(levels, k) + above


def source_trails(sources: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(name, of_parts, trail, root): of each source (name, digest, of_parts) the way to the dataset's root."""
    partitions = partitions_of(sources.withColumn("tree", F.lit("")), ["name"], height)
    known = exchanged(partitions).select(F.col("part").alias("of_part"), F.col("node").alias("root"), "trail")
    rows = partitions.join(known, F.col("part") == F.col("of_part")).select("members", "parts", "trail", "root")

    def run(batches):
        for batch in batches:
            out = [(m["name"], m["of_parts"], [{"place": p, "others": o} for p, o in t], r["root"]) for r in batch.to_pylist() for m, t in _trails(r["members"], r["parts"], r["trail"], height)]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["name", "of_parts", "trail", "root"])

    return rows.mapInArrow(run, f"name string, of_parts long, trail {_TRAIL}, root string")


def proofs(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, trail_sha256, folded_root) of ``rows`` (doc_id, source, leaf, tampered).

    ``tampered`` is the leaf as it is found later, null where it was not
    looked at again; ``folded_root`` is where that one leads along the trail.
    """
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # the null source first, others by their bytes
    leaves = checkpointed(rows.select(name.alias("tree"), "doc_id", F.col("leaf").alias("digest"), "tampered"))
    partitions = partitions_of(leaves, ["doc_id", "digest"], height)
    ways = checkpointed(exchanged(partitions))
    sources = ways.where("part = 0").select(F.col("tree").alias("name"), F.col("node").alias("digest"), F.col("parts").alias("of_parts"))
    # one row a partition of the source, so that a large source's partitions are not one key
    above = source_trails(sources, height).select("name", "root", F.col("trail").alias("upper"), F.explode(F.sequence(F.lit(0), F.col("of_parts") - 1)).alias("of_part"))
    known = ways.join(above, (F.col("tree") == F.col("name")) & (F.col("part") == F.col("of_part")))
    known = known.select("name", "of_part", F.col("node").alias("subroot"), "root", F.concat("trail", "upper").alias("trail"))
    joined = partitions.join(known, (F.col("tree") == F.col("name")) & (F.col("part") == F.col("of_part"))).select("members", "parts", "subroot", "root", "trail")
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("members").type.value_type.field("doc_id").type
            for k in range(batch.num_rows):  # a partition at a time
                row, ids, out = batch.slice(k, 1).to_pylist()[0], [], []
                for m, trail in _trails(row["members"], row["parts"], row["trail"], height):
                    ids.append(m["doc_id"])
                    proof = digest_of([d for _, others in trail for d in others])
                    out.append((m["digest"], row["subroot"], row["root"], proof, fold(m["tampered"] or m["digest"], trail)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(list(c), pa.string()) for c in zip(*out, strict=True)]], ["doc_id", *names])

    return joined.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{n} string' for n in names)}")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each document's leaf, its proof, and whether the tampered text still leads to the root."""
    leaf = leaf_digest([F.col(c) for c in LEAF_COLUMNS])
    other = leaf_digest([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in LEAF_COLUMNS])
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(remainder_of_crc(F.col("doc_id"), 2) == 0, other).alias("tampered"))
    return proofs(rows, height).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


# crc32 of an id's decimal digits, as a number, by SQL's own list functions
_CRC = """(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT))"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, sha256({" || ".join(_field(c) for c in LEAF_COLUMNS)}) AS leaf,
           CASE WHEN {_CRC} % 2 = 0 THEN sha256({" || ".join(_field(c if c != "text" else "replace(text, chr(10), '')") for c in LEAF_COLUMNS)}) END AS tampered
    FROM documents
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes AS (
    SELECT source, 0 AS level, pos AS i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM ordered
    UNION ALL
    SELECT source, level + 1, i // {FANOUT}, sha256(string_agg(node, '' ORDER BY i)), (max(n) + {FANOUT - 1}) // {FANOUT} FROM nodes WHERE n > 1 GROUP BY source, level, i // {FANOUT}
), tops AS (
    SELECT source, node, level FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i, node, count(*) OVER () AS n FROM tops
    UNION ALL
    SELECT level + 1, i // {FANOUT}, sha256(string_agg(node, '' ORDER BY i)), (max(n) + {FANOUT - 1}) // {FANOUT} FROM upper WHERE n > 1 GROUP BY level, i // {FANOUT}
), places AS (
    SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS at, level AS high FROM tops
), ways AS (
    SELECT o.source, o.pos, n.level, n.i % {FANOUT} AS place, n.i, list(r.node ORDER BY r.i) FILTER (WHERE r.i <> n.i) AS others
    FROM ordered o JOIN nodes n ON n.source IS NOT DISTINCT FROM o.source AND n.i = o.pos // ({FANOUT} ** n.level)::BIGINT
    JOIN nodes r ON r.source IS NOT DISTINCT FROM n.source AND r.level = n.level AND r.i // {FANOUT} = n.i // {FANOUT}
    WHERE n.n > 1 GROUP BY ALL
    UNION ALL
    SELECT o.source, o.pos, p.high + u.level, u.i % {FANOUT}, u.i, list(r.node ORDER BY r.i) FILTER (WHERE r.i <> u.i)
    FROM ordered o JOIN places p ON p.source IS NOT DISTINCT FROM o.source JOIN upper u ON u.i = p.at // ({FANOUT} ** u.level)::BIGINT
    JOIN upper r ON r.level = u.level AND r.i // {FANOUT} = u.i // {FANOUT}
    WHERE u.n > 1 GROUP BY ALL
), trails AS (
    SELECT source, pos, list({{'place': place, 'others': coalesce(others, [])}} ORDER BY level) AS trail FROM ways GROUP BY source, pos
), folded AS (
    SELECT o.source, o.pos, 0 AS step, coalesce(o.tampered, o.leaf) AS node, coalesce(t.trail, []) AS trail
    FROM ordered o LEFT JOIN trails t ON t.source IS NOT DISTINCT FROM o.source AND t.pos = o.pos
    UNION ALL
    SELECT source, pos, step + 1, sha256(array_to_string(trail[step + 1].others[:trail[step + 1].place], '') || node || array_to_string(trail[step + 1].others[trail[step + 1].place + 1:], '')), trail
    FROM folded WHERE step < len(trail)
)
SELECT o.doc_id, o.leaf, s.node AS subroot, (SELECT node FROM upper WHERE n = 1) AS root,
       sha256(array_to_string(flatten(list_transform(f.trail, lambda t: t.others)), '')) AS proof_sha256,
       f.node AS folded_root, f.node = (SELECT node FROM upper WHERE n = 1) AS verified
FROM ordered o JOIN folded f ON f.source IS NOT DISTINCT FROM o.source AND f.pos = o.pos AND f.step = len(f.trail)
JOIN tops s ON s.source IS NOT DISTINCT FROM o.source
"""
