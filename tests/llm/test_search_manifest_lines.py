"""Interval search, Merkle manifest and line counts against brute force, on small hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import interval_search, line_counts, merkle_manifest
from test_llm_operators import SCHEMA, hard_docs, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["dropped", "known_id", "known_key", "text_key", "n", "terms", "counts", "tree", "leaf", "pos", "part", "parts", "digest", "key", "at"]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(docs):
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


# --- 11 ranked search ---------------------------------------------------------------


def brute_search(docs, items, top=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(A_Z)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        asked = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in set(TERM.findall((text or "").translate(A_Z)))]
        scored = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            scored.append((-sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked if t in c), i is None, i or 0))
        out += [(item, k, None if none else i, -minus) for k, (minus, none, i) in enumerate(sorted(s for s in scored if s[0] < 0)[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, prose(1, 20)), (2, None), (3, ""), (4, "  .,! "), (5, "ONE two É 日本語"), (5, "other words of item five one"), (6, prose(1, 300)), (6, prose(1, 300)), (None, "ha ha one"), (7, "nowhere_at_all zzzzz")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").repartition(3)


@pytest.mark.parametrize("terms, postings", [(200_000, 1 << 20), (5, 7)])
def test_search(spark, items, empty, terms, postings):
    docs = spark.createDataFrame(hard_docs(), SCHEMA).repartition(3)
    want = brute_search([r[:2] for r in hard_docs()], ITEMS)
    for table in (docs, clash(docs)):
        found = interval_search.ranked_search(table, clash(items), terms=terms, postings=postings)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert interval_search.ranked_search(empty, items).count() == 0
    assert interval_search.ranked_search(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_intervals_find_the_best(seed):
    """Many equal scores, few and many terms, several shards that share their best."""
    pick = np.random.default_rng(seed)
    n, v = int(pick.integers(1, 400)), int(pick.integers(1, 30))
    per_doc = pick.integers(0, v + 1, n)
    terms = np.concatenate([pick.permutation(v)[:k] for k in per_doc]).astype(np.int32)
    counts = pick.integers(1, 1 + seed % 3 + 1, len(terms)).astype(np.int32)
    sizes = pick.integers(1, 4, n) * 10
    weights = pick.integers(0, 3, v) * 100
    ids = [int(i) for i in pick.permutation(n)]
    ends = np.r_[0, np.cumsum(per_doc)]
    asked = np.sort(pick.permutation(v)[: int(pick.integers(1, v + 1))])
    best, scored = interval_search.Best(10), 0
    for a in range(0, n, 150):
        b = min(n, a + 150)
        shard = interval_search.Shard(ids[a:b], sizes[a:b], per_doc[a:b], terms[ends[a] : ends[b]], counts[ends[a] : ends[b]], weights, n, int(sizes.sum()))
        scored += shard.search(asked, best)
    m = 10 + 90 * sizes * n // int(sizes.sum())
    want = []
    for i in range(n):
        t, c = terms[ends[i] : ends[i + 1]].astype(int), counts[ends[i] : ends[i + 1]].astype(int)
        score = sum(int(weights[x]) * (10**9 * int(y) // (1000 * int(y) + 8 * int(m[i]))) for x, y in zip(t, c, strict=True) if x in asked)
        want += [(-score, False, ids[i])] if score else []
    assert best.rows == sorted(want)[:10] and scored <= n


# --- 12 Merkle manifest ---------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, k):
    for level in levels[:-1]:
        start = k // 3 * 3
        yield k - start, level[start:k] + level[k + 1 : start + 3]
        k //= 3


def brute_manifest(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for k, r in enumerate(by[s]):
            trail = [*way(trees[s], k), *way(top, i)]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4].replace("\n", "")))
            for place, others in trail:
                node = sha(*others[:place], node, *others[place:])
            out.append((r[0], trees[s][0][k], trees[s][-1][0], top[-1][0], sha(*[d for _, o in trail for d in o]), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, height", [(1, 5), (130, 1), (95, 2), (60, 5)])
def test_manifest(spark, size, height):
    pick = random.Random(size)
    rows = [(pick.choice([None, i, i // 2]), "hot" if pick.random() < 0.5 else pick.choice([None, "", "-", "é", *"abcdefg"]), pick.choice([None, "en"]), pick.choice([None, 7]), pick.choice([None, "", "x\ny", "z"])) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    found = merkle_manifest.manifest(clash(docs), height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("parts", [*range(1, 12), 27, 28, 31, 80])
def test_each_partition_learns_its_way(spark, parts):
    """Whatever their number, all partitions end with the same root and right siblings, by no way down."""
    nodes = [sha(str(k)) for k in range(parts)]
    state = spark.createDataFrame([("t", k, parts, n) for k, n in enumerate(nodes)], "tree string, part long, parts long, node string")
    levels = tree(nodes)
    found = {r.part: r for r in merkle_manifest.exchanged(state).collect()}
    assert len(found) == parts
    for k, r in found.items():
        assert r.node == levels[-1][0] and [(t.place, t.others) for t in r.trail] == list(way(levels, k))


def test_manifest_of_nothing(empty):
    assert merkle_manifest.manifest(empty).count() == 0


# --- 13 line counts -------------------------------------------------------------------


def brute_line_counts(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(A_Z)
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k for k, line in enumerate(lines) if i is not None and len(holders[key(line)]) >= min_docs and i != max(holders[key(line)])]
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), gone))
    return sorted(out, key=repr)


def line_rows():
    long = "A line of WORDS that is long enough to count, é日本"
    pick = random.Random(3)
    rows = [(i, "\n".join(pick.choice([long, f" \t{long.translate(A_Z)}\r", "short", "", f"own line of document {i} and nobody else's at all", long + "x" * (i % 3)]) for _ in range(pick.randint(0, 7)))) for i in range(40)]
    return [*rows, (1, long), (1, long), (40, None), (41, ""), (None, long), (None, None), (42, "\n" * 5), (43, (long + "\n") * 3000), (44, long), (45, " " * 60)]


@pytest.mark.parametrize("min_chars, min_docs, hot", [(40, 5, 1000), (1, 2, 1), (5, 41, 10)])
def test_line_counts(spark, monkeypatch, min_chars, min_docs, hot):
    monkeypatch.setattr(line_counts, "HOT", hot)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in line_rows()], SCHEMA).repartition(3)
    want = brute_line_counts(line_rows(), min_chars, min_docs)
    for table in (docs, clash(docs)):
        found = line_counts.drop_frequent_lines(table, min_chars, min_docs, dropped_col="dropped")
        assert found.columns[: len(table.columns)] == table.columns
        name = found.columns[-1]
        assert sorted([(r.doc_id, r.text, r[name]) for r in found.collect()], key=repr) == want
        assert line_counts.drop_frequent_lines(table, min_chars, min_docs).columns == table.columns


def test_line_counts_of_nothing(empty):
    assert line_counts.drop_frequent_lines(empty).count() == 0
