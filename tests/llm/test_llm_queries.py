"""The registered queries: against SQL where there is any; the pipeline against brute force."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pointloom.llm import labelled, packing, quality_rules, registry, subword_classifier

import corpus_pipeline
from conftest import rows_of
from test_llm_operators import BYTES, SCHEMA, brute_components, brute_fingerprint, brute_lines, hard_docs


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows_of(registry.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(registry.SQL[name]).df())


def test_each_operator_has_a_query(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_fingerprints_and_components_of_the_table(spark, sf):
    rows = registry.QUERIES["op5_ball_hashing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = brute_components(set(fps.values()))
    small = {}
    for i, f in fps.items():
        small[root[f]] = min(small.get(root[f], i), i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", small[root[f]]) for i, f in fps.items()}


def held_out(spark, name, label):
    """(labels, predictions) of the held-out documents of sf0.01 by the registered query, which scores every document."""
    folder = "/root/testdata/sf0.01"
    rows = registry.QUERIES[name](spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r[label] is not None}
    pairs = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    return np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])


def test_held_out_toxicity(spark):
    label, said = held_out(spark, "op4_weak_supervision", "toxic")
    assert said[label == 1].mean() >= 0.9 and said[label == 0].mean() <= 0.05


def test_held_out_quality(spark):
    label, said = held_out(spark, "op10_subword_embeddings", "quality")
    assert said[label == 1].mean() >= 0.95 and said[label == 0].mean() <= 0.2


def test_quality_scores_are_the_models(spark, sf):
    """Every document of the table gets what the model, trained here on the same rows, says of its whole text."""
    docs, labels, settings = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), subword_classifier.SubwordSettings()
    rows = labelled.training_rows(docs, labels, "quality", 5, 0, settings.max_docs)
    model = subword_classifier.SubwordModel.fit([t for t, _ in rows], [y for _, y in rows], settings)
    want = {r.doc_id: softmax_score(model, r.text or "") for r in docs.collect()}
    found = {r.doc_id: r.score for r in registry.QUERIES["op10_subword_embeddings"](spark, sf).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-4 for i in want)


def softmax_score(model, text):
    """The score from vectors and layer themselves: mean, linear layer, softmax."""
    buckets, shares = subword_classifier.features_of(text, model.settings)
    logits = model.layer.astype(float) @ (shares.astype(float) @ model.vectors[buckets])
    return float(np.exp(logits[1]) / np.exp(logits).sum())


def brute_pipeline(rows):
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    rows = [r for r in rows if quality_rules.measures_of(r[1] or "", compress, quality_rules.QualityLimits())[6]]
    best = {}
    for r in rows:
        if r[1] not in best or (r[0] if r[0] is not None else -1) > (best[r[1]][0] if best[r[1]][0] is not None else -1):
            best[r[1]] = r
    rows = list(best.values())
    root, small = brute_components({brute_fingerprint(r[1]) for r in rows if r[0] is not None}), {}
    for r in rows:
        if r[0] is not None:
            c = root[brute_fingerprint(r[1])]
            small[c] = min(small.get(c, r[0]), r[0])
    rows = [r for r in rows if r[0] is None or small[root[brute_fingerprint(r[1])]] == r[0]]
    gone, library = brute_lines(rows), Tokenizer.from_file(BYTES)
    out = Counter()
    for i, text, *_ in rows:
        left, at = "", 0
        for a, b in gone.get((i, text), []):
            left, at = left + text[at:a], b
        ids = np.array([*library.encode(left + text[at:], add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for n in packing.lengths_of(len(ids)):
            out[i, start, n, __import__("zlib").crc32(ids[start : start + n].tobytes()), len(ids)] += 1
            start += n
    return out


@pytest.mark.parametrize("source", ["hard", "table"])
def test_pipeline(spark, sf, tmp_path, source):
    if source == "hard":
        spark.createDataFrame(hard_docs(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
        rows, folder = hard_docs(), str(tmp_path)
    else:
        rows, folder = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()], sf
    found = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == brute_pipeline(rows)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.where("false"), sf).count() == 0
