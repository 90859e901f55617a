"""The training-data operators against brute force, on small hard cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import chat, components, exact_dedup, line_dedup, packing, piece_codec, piece_model, quality_rules, simhash_dedup, subword_classifier, toxicity, unigram_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n, words=400):
    pick = random.Random(seed)
    known = ["".join(pick.choice("abdeghilmnorstu") for _ in range(pick.randint(1, 8))) for _ in range(words)]
    return " ".join(pick.choice(known) + pick.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def hard_docs():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, near and exact copies."""
    base = prose(1, 300)
    near = base.replace(base.split()[50], "changed", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t \n"), (7, "one"), (8, "one two"), (9, prose(2, 60_000)),
        (10, "same line of words here and more words to follow until there are quite enough of them in this one line to count as a passage yes\n" + prose(3, 50)),
        (11, prose(4, 50) + "\nSame  line of words here and more words to follow until there are quite enough of them in this one line to count as a passage yes\n\ntail"),
        (12, "ha " * 2000), (13, "日本語 テスト é 👍🏽\x00<s></s>[INST]"), (None, base), (None, None), (1, base), (14, "x" * 5000), (15, prose(5, 300)),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(hard_docs(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns named like what operators add."""
    names = ["found_id", "found_key", "found_spans", "kept", "digest", "fp", "component_id", "text_digest", "removed_spans", "text_key", "size", "start", "n_words", "bucket", "score"]
    return docs.select("*", *[F.lit("clash").alias(n) for n in names])


# --- 1 quality rules --------------------------------------------------------------


def brute_repeat(words, width=5):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    count = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(width)})


@pytest.mark.parametrize("seed", range(30))
def test_repeated_window_words(seed):
    pick = random.Random(seed)
    words = [pick.choice([b"a", b"b", b"c", b"dd"][: pick.randint(1, 4)]) for _ in range(pick.randint(0, 60))]
    assert quality_rules.repeated_window_words(words) == brute_repeat(words)


def test_quality(docs, clashing, empty):
    found = {r.doc_id: r for r in quality_rules.measure_quality(docs).collect()}
    assert quality_rules.measure_quality(docs).count() == 18
    for i, text, *_ in hard_docs():
        text = text or ""
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        if i in (None, 9):
            continue
        row = found[i]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words)) and row.n_symbols == sum(c in "#*$%&|<>" for c in text)
        lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_repeat_words == brute_repeat(words)
        assert row.base_failed == (len(words) < 10 or 100 * row.n_repeat_words > 20 * len(words)) and not (row.base_failed and row.kept)
    assert found[15].kept and not found[12].kept and not found[14].kept
    kept = quality_rules.keep_quality(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, r in [(i, found[i]) for i, *_ in hard_docs() if i is not None] if r.kept)
    assert quality_rules.measure_quality(empty).count() == quality_rules.keep_quality(empty).count() == 0


def test_bands_are_fitted(spark, clashing, empty):
    """Bands from good documents keep these, and tell repetition and noise; without documents nothing changes."""
    limits, compress = quality_rules.QualityLimits(), zstandard.ZstdCompressor(level=3).compress
    assert quality_rules.fit_bands(empty) == quality_rules.fit_bands(clashing) == limits  # too few stretches
    rows = [(i, prose(i, 20 + i * 3), "en", "s", 0) for i in range(300)]
    fitted = quality_rules.fit_bands(spark.createDataFrame(rows, SCHEMA), tail=0.0)
    assert fitted.bands != limits.bands and [b[0] for b in fitted.bands] == [b[0] for b in limits.bands]
    stretches = [pair for _, text, *_ in rows for pair in quality_rules.stretch_ratios(text, compress, limits)]
    for start, low, high in fitted.bands:
        own = [r for n, r in stretches if n == start]
        if len(own) >= 200:  # brute force
            assert abs(low - min(own) * quality_rules.LOW_MARGIN) < 1e-9 and abs(high - max(own) * quality_rules.HIGH_MARGIN) < 1e-9
        else:
            assert (start, low, high) in limits.bands
    assert all(quality_rules.compression(text.encode(), compress, fitted)[2] for _, text, *_ in rows if len(text) < 4096)
    assert not quality_rules.compression(b"\0".join([b"spam and eggs"] * 200), compress, fitted)[2]
    assert not quality_rules.compression(random.Random(1).randbytes(3000), compress, fitted)[2]


def test_compression_bands():
    limits, compress = quality_rules.QualityLimits(), zstandard.ZstdCompressor(level=3).compress
    noise = random.Random(1).randbytes(3000).hex()
    assert not quality_rules.compression(b"\0".join([b"spam and eggs"] * 800), compress, limits)[2]
    assert not quality_rules.compression(random.Random(1).randbytes(20000), compress, limits)[2]
    assert quality_rules.compression(prose(3, 3000).encode(), compress, limits)[2]
    mixed = (prose(3, 900) + "z" * 6000).encode()
    assert quality_rules.compression(mixed, compress, limits)[1] > 30 and len(noise)


@pytest.mark.parametrize("size", [128, 200, 256, 400, 700, 1024, 2048, 4096, 5000, 10_000, 40_000])
def test_bands_reject_noise_at_each_length(size):
    limits, compress = quality_rules.QualityLimits(), zstandard.ZstdCompressor(level=3).compress
    for seed in range(20):
        pick = random.Random(seed)
        coded = __import__("base64").encodebytes(pick.randbytes(size))[:size]
        assert not quality_rules.compression(coded, compress, limits)[2]
        words = " ".join(pick.randbytes(16).hex() for _ in range(size // 33 + 1)).encode()[:size]
        if size >= 4096:  # shorter hex shrinks as prose does
            assert not quality_rules.compression(words, compress, limits)[2]
            assert not quality_rules.compression(pick.randbytes(size).hex().encode()[:size], compress, limits)[2]


def test_bands_lie_close_around_prose():
    bands = quality_rules.QualityLimits().bands[1:]
    assert all(low < prose[1] < prose[2] < high < 1.3 * prose[2] for (_, low, high), prose in zip(bands, [*quality_rules.PROSE, quality_rules.PROSE[-1]], strict=True))


def test_labelled_good_documents_stay(spark, sf):
    rows = quality_rules.measure_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert rows.where("quality = 1 and not base_failed and not kept").count() == 0


# --- 2 exact dedup ------------------------------------------------------------------


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_groups(docs, counters):
    groups = defaultdict(list)
    for i, text, *_ in hard_docs():
        groups[text or ""].append(i)
    found = defaultdict(list)
    for r in exact_dedup.exact_groups(docs, counters).collect():
        found[bytes(r.digest)].append(r)
    assert len(found) == len(groups)
    for text, ids in groups.items():
        rows = found[hashlib.sha256(text.encode()).digest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in rows) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in rows} == {(keep, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [keep]


def test_drop_exact(docs, clashing, empty):
    kept = exact_dedup.drop_exact_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.count() == len({t or "" for _, t, *_ in hard_docs()})
    assert exact_dedup.drop_exact_duplicates(empty).count() == exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_misra_gries_bound(seed):
    pick, counters = random.Random(seed), 7
    rows = [pick.choice("aaaabbbccdefghijklmnopqrstuvwxyz") for _ in range(500)]
    held = Counter()
    for k in range(0, 500, 40):
        held = exact_dedup.merge_counts(held, Counter(rows[k : k + 40]), counters)
    assert len(held) <= counters
    for key, n in Counter(rows).items():
        assert n - 500 / (counters + 1) <= held[key] <= n


# --- 3 unigram counts -----------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram():
    with open(PIECES, "rb") as file:
        raw = unigram_counts.unigram_from_ranks(file.read())
    return raw, sentencepiece.SentencePieceProcessor(model_proto=raw)


def strange_texts(n, seed=0):
    pick = random.Random(seed)
    bits = [" ", "  ", "▁", "\n", "\t", "\0", "the", "a", "ab", "Ünï", "日本", "👍🏽", "<s>", "</s>", "é", "ﬁ", "12", "'s", "!!", "\x85", "\x1c", "　", "\r\n"]
    return ["".join(pick.choice(bits) for _ in range(pick.randint(0, 25))) for _ in range(n)]


def test_counts_equal_library(spark, docs, unigram):
    raw, library = unigram
    counter = unigram_counts.UnigramCounter(piece_model.read_model(raw))
    for text in [*strange_texts(1500), prose(1, 3000)]:
        assert counter(text)[0] == len(library.encode(text)), repr(text)
        if text:
            assert counter.search(counter.normalize(text)[0].decode())[0] == len(library.encode(text))
    found = unigram_counts.count_tokens(docs, raw).collect()
    want = Counter((i, len(library.encode(t or ""))) for i, t, *_ in hard_docs())
    assert Counter((r.doc_id, r.n_tokens) for r in found) == want


# --- 4 toxicity, 10 quality ------------------------------------------------------------


def split(spark, sf, label, divisor, out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % divisor == out
    return [(r.text, r[label]) for r in rows if not held(r.doc_id)], [(r.text, r[label]) for r in rows if held(r.doc_id)]


def test_quality_classifier_on_held_out(spark, sf):
    train, test = split(spark, sf, "quality", 5, 0)
    model = subword_classifier.SubwordModel.fit([t for t, _ in train], [y for _, y in train])
    right = np.mean([(model.score(t) >= 0.3) == bool(y) for t, y in test])
    assert right > 0.95


def test_toxicity_on_held_out(spark, sf):
    train, test = split(spark, sf, "toxic", 4, 2)
    model = toxicity.ToxicityModel.fit([t for t, _ in train], [y for _, y in train])
    scores = [model.score(t) for t, _ in test]
    found = [bool(y) for s, (_, y) in zip(scores, test) if s >= 0.3]
    assert sum(found) >= 0.9 * sum(y for _, y in test) and sum(found) >= 0.8 * len(found) and all(0 <= s <= 1 for s in scores)


def test_label_model_finds_accuracies_and_families():
    random_ = np.random.default_rng(0)
    y = random_.random(4000) < 0.2
    fires = np.array([[0.01, 0.6], [0.02, 0.4], [0.05, 0.3], [0.3, 0.3]])
    votes = (random_.random((4000, 4)) < np.where(y[:, None], fires[:, 1], fires[:, 0])).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that repeats another
    start = np.where(votes[:, :2].any(1), 0.9, 0.05)
    rate = votes.mean(0)
    model = toxicity.LabelModel.fit(votes, start, 0.2, np.stack([rate, rate]), np.full(5, 1.0), 30)
    assert model.fires[1, 0] > 0.4 and model.fires[0, 0] < 0.05 and abs(model.fires[1, 3] - 0.3) < 0.1
    assert model.families[0] == model.families[4] != model.families[3]  # the pair is one family, and speaks once
    belief = model.posterior(votes)
    assert np.mean((belief > 0.5) == y) > 0.85
    once = toxicity.LabelModel.fit(votes[:, :4], start, 0.2, np.stack([rate, rate])[:, :4], np.full(4, 1.0), 30)
    assert np.abs(once.posterior(votes[:, :4]) - belief).mean() < 0.05


def test_groups_of_linked_voters():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert toxicity._groups(linked).tolist() == [0, 1, 1, 0, 2, 0]
    assert toxicity._groups(np.zeros((0, 0), bool)).tolist() == []


def test_beginnings_of_few_documents():
    """Two toxic documents with many words of one beginning tell it; copies of a document tell nothing more."""
    plain = [prose(k, 60) for k in range(40)]
    toxic = [prose(90 + k, 30) + " " + " ".join(f"zorgel{w}" for w in ("ab", "en", "is", "um", "ox")[k : k + 4]) for k in (0, 1)]
    found = toxicity.telling_beginnings([*plain, *toxic], np.array([0] * 40 + [1, 1]), toxicity.ToxicitySettings())
    assert "zorgel-" in found and all("zorgel-".startswith(t[:-1]) or t.startswith("zorgel") for t in found)
    one = toxicity.telling_beginnings([*plain, *[prose(99, 30) + " zorgelab zorgelen"] * 5], np.array([0] * 40 + [1] * 5), toxicity.ToxicitySettings())
    assert "zorgel-" not in one


@pytest.mark.parametrize("model", [subword_classifier.SubwordModel.fit([], []), subword_classifier.SubwordModel.fit(["a"], [1]), toxicity.ToxicityModel.fit([], []), toxicity.ToxicityModel.fit(["a", ""], [0, 0])])
def test_one_class_scores_are_constant(model):
    assert model.score("anything") == model.score("") and 0 < model.score("") < 1


def test_scoring_hard_rows(docs, empty):
    from pointloom.llm.labelled import score_documents

    texts = [(prose(k, 40), 1) for k in range(10)] + [("BUY!! NOW!! " * k, 0) for k in range(1, 8)]
    for kind in (subword_classifier.SubwordModel, toxicity.ToxicityModel):
        model = kind.fit([t for t, _ in texts], [y for _, y in texts])
        rows = score_documents(docs, model, 4, 2).collect()
        assert len(rows) == 18 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
        assert score_documents(empty, model, 4, 2).count() == 0


# --- 5 near dedup -------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fp -> smallest member index set, by comparing all."""
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_groups(docs, empty):
    rows = simhash_dedup.near_groups(docs).collect()
    fps = {brute_fingerprint(t) for _, t, *_ in hard_docs()}
    known = {brute_fingerprint(t) for i, t, *_ in hard_docs() if i is not None}
    root, smallest = brute_components(known), {}
    for i, t, *_ in hard_docs():
        if i is not None:
            r = root[brute_fingerprint(t)]
            smallest[r] = min(smallest.get(r, i), i)
    want = Counter((i, brute_fingerprint(t), None if i is None else smallest[root[brute_fingerprint(t)]]) for i, t, *_ in hard_docs())
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == want and len(fps)
    assert simhash_dedup.near_groups(empty).count() == 0


def family(seed, n, flips, centres=1):
    pick = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = pick.getrandbits(64)
        out.add(c)
        while len(out) < n // centres * (len(out) // (n // centres) + 1) and len(out) < n:
            v = c
            for b in pick.sample(range(64), pick.randint(0, flips)):
                v ^= 1 << b
            out.add(v)
            if len(out) % (n // centres) == 0:
                break
    return sorted(out)


@pytest.mark.parametrize("small", [0, 4, 32])
@pytest.mark.parametrize("seed, n, flips, centres", [(1, 200, 3, 1), (2, 150, 2, 3), (3, 120, 6, 2), (4, 100, 1, 25)])
def test_links_connect_all_pairs(spark, monkeypatch, small, seed, n, flips, centres):
    """Also families so dense that buckets go the second way (small buckets of 0 and 4)."""
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    fps = family(seed, n, flips, centres)
    frame = spark.createDataFrame([(simhash_dedup._signed(f),) for f in fps], "fp long")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash_dedup.near_links(frame).collect()]
    assert all((u ^ v).bit_count() <= 3 and u != v for u, v in links)
    want = brute_components(fps)
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in links:
        root[find(u)] = find(v)
    assert len({find(f) for f in fps}) == len(set(want.values()))
    assert all((find(a) == find(b)) == (want[a] == want[b]) for a, b in zip(fps, fps[1:]))


def test_components(spark):
    pick = random.Random(7)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 580)] + [(pick.randint(1000, 1100), pick.randint(1000, 1100)) for _ in range(70)] + [(3, 3), (9, 8), (8, 9)]
    root = {v: v for e in edges for v in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.components(frame).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}
    assert components.components(frame.where("false")).count() == 0


def test_drop_near(clashing):
    kept = simhash_dedup.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    groups = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(clashing).collect() if r.doc_id is not None}
    rows = [r.doc_id for r in kept.collect()]
    assert set(rows) == {i for i, c in groups.items() if i == c} | {None}
    assert rows.count(1) == 1 and rows.count(None) == 2  # repeated rows leave one, rows without an id all stay


def test_drop_near_judges_texts_of_one_id_apart(spark):
    a, b, c = prose(31, 200), prose(32, 200), prose(33, 200)
    rows = [(7, a), (7, b), (3, b), (9, a + " more"), (7, c), (7, a)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id, r.text) for r in simhash_dedup.drop_near_duplicates(frame).collect())
    assert kept == sorted([(3, b), (7, a), (7, c)])


# --- 6 pieces ---------------------------------------------------------------------------


def test_codec_equals_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = piece_codec.OffsetEncoder(PIECES)
    texts = [*strange_texts(1500, 1), *(t or "" for _, t, *_ in hard_docs())]
    for text, (ids, begin, end) in zip(texts, encoder.many(texts)):
        assert piece_codec.unpack(ids) == [1, *library.encode(text), 2], repr(text)
        raw, covered = text.encode(), 0
        assert begin[0] == end[0] == 0 and begin[-1] == end[-1] == len(raw)
        for b, e in zip(begin[1:-1], end[1:-1]):
            assert b <= covered and b <= e
            covered = max(covered, e)
            raw[b:e].decode()  # spans end between characters
        assert covered == len(raw)
    rows = piece_codec.encode(docs, PIECES).collect()
    want = Counter((i, len(library.encode(t or "")) + 2, library.decode([1, *library.encode(t or ""), 2])) for i, t, *_ in hard_docs())
    assert Counter((r.doc_id, r.n_tokens, r.decoded) for r in rows) == want


def brute_spans(text, library):
    """[begin, end) in the original's UTF-8 of each piece, where the model changes nothing but spaces."""
    if not text:
        return []
    source, at = [], 0  # byte of the text for each byte of the normalised text
    marked = [("▁", 0)]
    for c in text:
        marked.append(("▁" if c == " " else c, len(c.encode())))
    chars = []
    for c, size in marked:
        chars.append((len(c.encode()), at, at + size))
        source += [(at, at + size)] * len(c.encode())
        at += size
    out, place = [], 0
    for piece in library.encode(text, out_type=str):
        size = 1 if len(piece) == 6 and piece.startswith("<0x") else len(piece.encode())
        out.append((source[place][0], source[place + size - 1][1]))
        place += size
    assert place == len(source)
    return out


def test_spans_equal_brute_force(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = piece_codec.OffsetEncoder(PIECES)
    texts = [t for t in strange_texts(800, 5) if "▁" not in t] + [prose(1, 400), "日本語 テスト", " a  b ", "x" * 300]
    for text, (_, begin, end) in zip(texts, encoder.many(texts)):
        assert list(zip(begin[1:-1].tolist(), end[1:-1].tolist())) == brute_spans(text, library), repr(text)
    rows = {r.doc_id: r for r in piece_codec.span_digests(piece_codec.encode(docs, PIECES)).collect()}
    for i, t, *_ in hard_docs():
        if i is not None:
            size, spans = len((t or "").encode()), brute_spans(t or "", library)
            begins, ends = np.array([[0, 0], *spans, [size, size]], "<u4").T
            assert rows[i].spans_sha256 == hashlib.sha256(begins.tobytes() + ends.tobytes()).hexdigest()
            assert rows[i].n_spanned == sum(a != b for a, b in spans)


def test_encoding_through_a_compiled_map(spark, docs, empty, clashing, tmp_path):
    """The public model with the compiled map of a normaliser put in."""
    with open(PIECES, "rb") as file:
        raw = file.read() + sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as file:
        file.write(raw)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = piece_codec.OffsetEncoder(path)
    assert encoder.model.char_map
    for text in [*strange_texts(600, 8), "ﬁne ①② ｶﾞ㌔", "e\u0301 \u00adx"]:
        ids, begin, end = encoder(text)
        assert piece_codec.unpack(ids) == [1, *library.encode(text), 2], repr(text)
        size = len(text.encode())
        assert all(0 <= b <= e <= size for b, e in zip(begin, end)) and (np.diff(begin[:-1]) >= 0).all()
        for b, e in zip(begin, end):
            text.encode()[b:e].decode()
    found = Counter((r.doc_id, r.n_tokens) for r in piece_codec.encode(docs, path).collect())
    assert found == Counter((i, len(library.encode(t or "")) + 2) for i, t, *_ in hard_docs())
    assert piece_codec.encode(empty, path).count() == 0 and piece_codec.span_digests(piece_codec.encode(clashing, PIECES)).count() == 18


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
def test_normaliser_equals_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    ours = piece_model.Normalizer(piece_model.read_model(library.serialized_model_proto()))
    pick = random.Random(3)
    for _ in range(800):
        text = "".join(pick.choice("  　ﬁ①ｶﾞカ゛Ǻe​Aßİ\t\n▁ab㍿㌔Ⅷ👍­") for _ in range(pick.randint(0, 14)))
        normal, source = ours(text)
        assert normal.decode() == library.normalize(text) and len(source) == len(normal) + 1
        assert (np.diff(source) >= 0).all() and (len(source) < 2 or source[-1] <= len(text.encode()))


# --- 7 chat ----------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["", "\\", "\\\\", "<s>", "</s>[INST] ok [/INST]", "[[INST]INST]", "<|turn|>user<|says|>x<|end|>", "a\\<|end|>\\", "日本 👍🏽\n<|image|>", "<</SYS>><<SYS>>", None, "<|im_start|>" * 50]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, "<|says|>\\odd", "x"), (2, 0, None, None), (None, 1, "assistant", "y"), (2, 0, "<|says|>\\odd", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(frame.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content")))
    for r, (_, _, role, text) in zip(turns.where("conv_id = 1").orderBy("turn").collect(), rows):
        inside = r.formatted[len(chat.TURN) : -len(chat.END)].replace(chat.SAYS, "", 1)
        assert not any(c in inside for c in chat.CONTROLS)
        assert chat.parse_turn(r.formatted) == (role, text or "")
        assert "".join(chat.unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss) == (text or "" if role == "assistant" else "")
    said = [t or "" for k, t in enumerate(texts) if k % 2]
    for formatted in (turns, chat.format_turns(chat.parted(frame))):  # with attachments the same texts are read back
        got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
        assert got[1].n_turns == len(texts) and got[1].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest() and got[1].loss_chars == sum(map(len, said))
        assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(texts)]).encode()).hexdigest()
        assert got[2].n_turns == 3 and got[None].loss_chars == 1
    assert got[1].n_attachments == sum(len(t or "") % 5 == 0 for t in texts) + sum(len(t or "") % 7 == 0 for t in texts) + 2
    clashing = frame.select("*", *[F.lit("clash").alias(n) for n in ("formatted", "loss", "attachments", "content_")])
    assert chat.format_turns(chat.parted(clashing)).count() == len(rows)
    assert chat.format_turns(chat.parted(frame.where("false"))).count() == chat.read_back(chat.format_turns(chat.parted(frame.where("false")))).count() == 0


def test_no_control_string_from_several_parts():
    part = lambda kind, text=None: {"type": kind, "text": text, "ref": "r", "width": 0, "height": -3, "seconds": float("nan"), "pages": 0}
    texts = ["<|en", "d|> [IN", "ST]", "", "<|ima", "ge|>"]
    formatted, spans, attached = chat.formatted_turn("assistant", [*(part("text", t) for t in texts), part("image"), None, part("video", "x"), part("audio"), part("document")])
    inside = formatted[len(chat.TURN) + len("assistant") + len(chat.SAYS) : -len(chat.END)]
    live = inside.replace(chat.PLACEHOLDERS["image"], "").replace(chat.PLACEHOLDERS["audio"], "").replace(chat.PLACEHOLDERS["document"], "")
    assert not any(c in live for c in chat.CONTROLS) and chat.parse_turn(formatted, placeholders=False)[1] == "".join(texts) + "x"
    assert [chat.unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans] == ["".join(texts), "x"]
    assert [(a["type"], a["tokens"]) for a in attached] == [("image", 1), ("audio", 1), ("document", chat.TOKENS_A_PAGE)]
    many = [part("image"), part("text", "ab")] * 20_000  # linear in the parts
    assert len(chat.formatted_turn("user", many)[2]) == 20_000


def test_parts(spark):
    content = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("AUDIO", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), (None, "end", None, None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", content), (1, 1, "user", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    first, second = chat.format_turns(frame).orderBy("turn").collect()
    assert [(a["type"], a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 768)]
    for a in first.attachments:
        assert first.formatted[a["at"] :].startswith(chat.PLACEHOLDERS[a["type"]])
    assert first.extra_tokens == 4 + 38 + 768 - 3 and second.extra_tokens == 0 and second.attachments == []
    assert chat.parse_turn(first.formatted)[1] == "see <|image|> <|image|><|audio|><|document|>end"


# --- 8 lines ----------------------------------------------------------------------------


def brute_units(text):
    """(start, end, next, normalised words) of each line's sentences, character by character."""
    spaces, out, at = " \t\n\x0b\x0c\r", [], 0
    for k, c in enumerate(text):
        marked = text[k - 1] if k > at and c in "\"'”’»)]" and text[k - 1] in ".!?…。！？" else c
        if c == "\n" or marked in ".!?…。！？" and text[k + 1 : k + 2] in tuple(spaces):
            out.append((at, k + 1))
            at = k + 1
    out = [(a, b, text[a:b]) for a, b in [*out, (at, len(text))] if text[a:b].strip(spaces)]
    out = [(a + len(p) - len(p.lstrip(spaces)), a + len(p.rstrip(spaces)), b" ".join(p.encode().lower().split())) for a, b, p in out]
    return [(a, b, n, norm) for (a, b, norm), n in zip(out, [*(u[0] for u in out[1:]), len(text)])]


def brute_lines(rows, min_words=line_dedup.MIN_WORDS):
    """{(doc_id, text): spans of removed passages}."""
    units = {(i, t or ""): brute_units(t or "") for i, t, *_ in rows if i is not None}
    first = {}
    for (i, t), out in sorted(units.items(), key=lambda x: (x[0][0], xx_signed(x[0][1]))):
        for k, u in enumerate(out):
            first.setdefault(u[3], (i, t, k))
    holders = defaultdict(set)
    for (i, _), out in units.items():
        for u in out:
            holders[u[3]].add(i)
    gone = {}
    for (i, t), out in units.items():
        spans, run, words = [], None, 0
        for k, (a, _, b, norm) in [*enumerate(out), (None, (0, 0, 0, None))]:
            if norm is not None and first[norm] != (i, t, k) and len(holders[norm]) > 1:
                run = (run[0] if run else a, b)
                words += len(norm.split())
                continue
            if run and words >= min_words:
                spans.append(run)
            run, words = None, 0
        if spans:
            gone[i, t] = spans
    return gone


def xx_signed(text):
    return simhash_dedup._signed(xxhash.xxh64_intdigest(text.encode(), 42))


@pytest.mark.parametrize("min_words", [1, 20])
def test_repeated_lines(docs, clashing, empty, min_words):
    want = brute_lines(hard_docs(), min_words)
    out = line_dedup.remove_repeated_lines(docs, min_words, spans_col="cut")
    before = defaultdict(list)
    for i, t, *_ in hard_docs():
        before[i].append(t)
    assert out.count() == 18
    cut_rows = 0
    for r in out.collect():
        if r.cut is None:
            assert r.text in before[r.doc_id]
            continue
        cut_rows += 1
        text = next(t for t in before[r.doc_id] if (r.doc_id, t or "") in want and [tuple(s) for s in r.cut] == want[r.doc_id, t])
        left, at = "", 0
        for a, b in want[r.doc_id, text]:
            left, at = left + text[at:a], b
        assert r.text == left + text[at:]
    assert cut_rows == sum((i, t or "") in want for i, t, *_ in hard_docs() if i is not None)
    assert line_dedup.remove_repeated_lines(clashing, min_words).columns == clashing.columns
    assert line_dedup.repeated_units(empty).count() == line_dedup.remove_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_units_of_strange_texts(seed):
    pick = random.Random(seed)
    for _ in range(300):
        text = "".join(pick.choice(["ab", "c", ".", "!", "?", "…", "”", ")", "'", " ", "  ", "\n", "\t", "\x0b", "Ü", "。", "\x85"]) for _ in range(pick.randint(0, 30)))
        assert [(a, b, n) for a, b, n, _, _ in line_dedup.units_of(text)] == [u[:3] for u in brute_units(text)], repr(text)


def test_passage_inside_lines(spark, empty):
    """A passage of sentences pasted into lines goes from all but one text, short boilerplate from none; no word of it is a line."""
    passage = "Once there was a very small house. It stood, they say,\nnear the old river bank! Nobody had lived in it for years (or so one heard). Then a tall man came and bought it. He paid in gold."
    texts = {k: f"{prose(100 + k, 40)} and so on.\nAll rights reserved. {passage} {prose(200 + k, 40)}" for k in range(5)}
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], SCHEMA)
    out = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(frame).collect()}
    assert out[0] == texts[0] and all(out[k] == texts[k].replace("All rights reserved. " + passage + " ", "") for k in range(1, 5))
    listed = line_dedup.repeated_units(frame)
    assert {r.keep_id for r in listed.where("removed").collect()} == {0}
    alone = frame.withColumn("text", F.concat(F.lit("All rights reserved. "), F.xxhash64("doc_id").cast("string")))
    found = line_dedup.repeated_units(alone).collect()
    assert len(found) == 4 and not any(r.removed for r in found)
    assert line_dedup.repeated_units(empty).count() == 0


# --- 9 packing ---------------------------------------------------------------------------


def test_lengths():
    for n in range(1, 5000):
        found = packing.lengths_of(n)
        assert sum(found) == n and all(x & (x - 1) == 0 for x in found) and found == sorted(found, reverse=True)


def test_cached_ids_equal_library():
    library = Tokenizer.from_file(BYTES)
    ours = packing.CachedTokenizer(BYTES)
    assert ours.ranked is not None
    texts = [*strange_texts(2500, 2), "a<|endoftext|>b", "hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|", prose(6, 2000), " x", "x ", "a\n\n\nb", "it's  we'll"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ours(text), "<u4").tolist() == want.ids, repr(text)


def test_pack(docs, empty):
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.bucket == r.length == len(r.ids) // 4 for r in rows)
    want = Counter(i for i, t, *_ in hard_docs() for _ in packing.lengths_of(len(library.encode(t or "", add_special_tokens=False).ids) + 1))
    assert Counter(r.doc_id for r in rows) == want
    for i, t, *_ in hard_docs():
        if i in (None, 1):
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = struct.unpack(f"<{sum(r.length for r in own)}I", b"".join(r.ids for r in own))
        assert list(ids) == [*library.encode(t or "", add_special_tokens=False).ids, 0] and {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTES, max_len=1000)


def test_buckets_are_folders_of_equal_lengths(spark, docs, tmp_path):
    packed = packing.pack(docs, BYTES)
    packing.write_buckets(packed, str(tmp_path / "packed"))
    folders = {int(p.name.split("=")[1]) for p in (tmp_path / "packed").iterdir() if "=" in p.name}
    assert folders == {r.length for r in packed.select("length").distinct().collect()}
    for size in folders:
        assert {r.length for r in spark.read.parquet(str(tmp_path / "packed" / f"bucket={size}")).collect()} == {size}
