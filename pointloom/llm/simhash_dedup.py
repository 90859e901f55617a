"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Fingerprints a and b that differ in at most r = 3 bits have a point between
them within half the radius of both. With the radius odd, half of it is 1 on
one side and 2 on the other, and a ball of radius 2 has 2,081 points; the
search below keeps the balls at radius 1 for almost all fingerprints:

1. The 64 bits are cut into ``PARTS`` = 3 parts. If a and b differ in 1 to 3
   bits, some part holds one of these bits, and outside it they differ in at
   most 2, so the balls of radius 1 *outside that part* meet. Every distinct
   fingerprint emits these variants (132 in all); the shuffle brings equal
   (part, variant) together. A bucket of at most ``SMALL`` fingerprints is
   verified pair by pair.
2. Fingerprints of larger buckets, which only families of near copies make,
   emit balls over all 64 bits: radius 1 from each, and from those with an odd
   number of ones also the points at distance 2 whose two bits lie in one half.
   (A pair at distance 3 has one odd member, and two of its three bits lie in
   one half.) Whatever meets a radius-1 member is within 3 bits of it, so each
   bucket gives a star of true links and no pairs are listed. A bucket has
   at most 1,057 members, by geometry.

Both steps together find every pair within 3 bits; nothing is capped. Links
between distinct fingerprints then give components; equal fingerprints are one
node from the start.

Defined cases: null and empty texts have no words and fingerprint zero, which
links like any other; fewer than three words are one shingle; a row without a
doc_id gets its fingerprint, links nothing, has no component and is never
dropped; repeated rows get equal results, and of them one stays; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, fresh, map_batches, narrow, texts_of
from .components import components

RADIUS = 3
#: Bit positions of the three parts and of the two halves.
PARTS = (range(0, 21), range(21, 42), range(42, 64))
HALVES = (range(0, 32), range(32, 64))
#: Largest bucket that is verified pair by pair.
SMALL = 32
SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: str) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the shingles' XXH64."""
    words = text.encode().lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and fp as a signed long."""
    rows = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_signed(fingerprint(t)) for t in texts_of(batch.column(2))]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"])

        return step

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def _masks(flips: list[int]):
    return F.array(*[F.lit(_signed(m)) for m in flips])


def _variants(fps: DataFrame) -> DataFrame:
    """(part, key, fp): for each part, the fingerprint outside it with at most one bit flipped."""
    out = None
    for k, part in enumerate(PARTS):
        blank = sum(1 << b for b in part)
        flips = [0, *[1 << b for b in range(64) if b not in part]]
        keys = fps.select(F.lit(k).alias("part"), "fp", F.explode(_masks(flips)).alias("flip"))
        keys = keys.select("part", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(_signed(~blank & (1 << 64) - 1))).alias("key"), "fp")
        out = keys if out is None else out.unionByName(keys)
    return out


def _near(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b}) <= {RADIUS}"


def _links_in_small(buckets: DataFrame) -> DataFrame:
    """Verified links of buckets of at most SMALL members."""
    members = buckets.where(F.col("size") <= SMALL).groupBy("part", "key").agg(F.collect_list("fp").alias("all"))
    left = members.select(F.explode("all").alias("u"), "all")
    return left.select("u", F.expr(f"explode(filter(all, x -> x > u and {_near('x', 'u')}))").alias("v")).distinct()


def _links_in_large(fps: DataFrame) -> DataFrame:
    """Star links that connect all pairs of ``fps`` within the radius."""
    one = [0, *[1 << b for b in range(64)]]
    two = [1 << a | 1 << b for half in HALVES for a in half for b in half if a < b]
    near = fps.select("fp", F.explode(_masks(one)).alias("flip")).withColumn("centre", F.lit(True))
    far = fps.where("bit_count(fp) % 2 = 1").select("fp", F.explode(_masks(two)).alias("flip")).withColumn("centre", F.lit(False))
    met = near.unionByName(far).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp", "centre")
    buckets = met.groupBy("key").agg(F.min(F.when(F.col("centre"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("all"))
    stars = buckets.where("u is not null and size(all) > 1").select("u", F.explode("all").alias("v"))
    return stars.where("u <> v").distinct()


#: Shared buckets (20 bytes each) up to which they are broadcast; more meet the variants by shuffle.
BROADCAST_BUCKETS = 200_000


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints: true links that connect all pairs within the radius."""
    # counts are summed before they are shuffled; variants that no other fingerprint has go no further
    met = _variants(fps).groupBy("part", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = checkpointed(met.select(F.col("part").alias("met_part"), F.col("key").alias("met_key"), "size"))
    met = F.broadcast(met) if met.count() <= BROADCAST_BUCKETS else met
    variants = _variants(fps)
    buckets = checkpointed(variants.join(met, (variants.part == met.met_part) & (variants.key == met.met_key)).select("part", "key", "fp", "size"))
    large = buckets.where(F.col("size") > SMALL).select("fp").distinct()
    return _links_in_small(buckets).unionByName(_links_in_large(large))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, fp (signed long), class_fp (the smallest fp reachable, which names the class), component_id (smallest doc_id reachable).

    Texts are read once. Equal fingerprints are aggregated before anything
    is emitted, so copies cost nothing.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = checkpointed(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(near_links(nodes.select("fp")))
    member = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class_fp"))
    member = checkpointed(member)
    smallest = member.groupBy("class_fp").agg(F.min("first_id").alias("component_id"))
    known = member.join(smallest, "class_fp").select(F.col("fp").alias("known_fp"), "class_fp", "component_id")
    joined = marked.join(known, F.col("fp") == F.col("known_fp"), "left")
    return joined.select("doc_id", "text_key", "fp", "class_fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with the columns it has.

    The verdict is on a row's doc_id and text: where one doc_id stands on
    several texts, each is judged in its own group (of those that have the
    smallest id, the one of the smallest text hash stays), and of rows that
    repeat both, one stays.
    """
    groups = checkpointed(near_groups(docs, id_col, text_col).where("doc_id is not null").select("doc_id", "text_key", "class_fp", "component_id"))
    heads = groups.where("doc_id = component_id").select("doc_id", "text_key", "class_fp")
    first = heads.groupBy(F.col("class_fp").alias("_class")).agg(F.min("text_key").alias("_first"))
    others = heads.join(first, (F.col("class_fp") == F.col("_class")) & (F.col("text_key") > F.col("_first"))).select("doc_id", "text_key")
    drop = groups.where("doc_id <> component_id").select("doc_id", "text_key").unionByName(others).distinct().withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    name = fresh(docs, "text_key")
    marked = docs.withColumn(name, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    left = marked.join(drop, (marked[id_col] == drop["_id"]) & (marked[name] == drop["_key"]), "left_anti")
    if groups.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():  # whole rows repeat
        left = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, name]).unionByName(left.where(F.col(id_col).isNull()))
    return left.drop(name)


def op5_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
