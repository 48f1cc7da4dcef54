"""Trained operators: held-out accuracy, degenerate training data, odd documents; and the pipeline."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from foliant.llm import labelled, quality, queries, toxicity

from . import odd


def labelled_rows(sf_dir, column):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    return [(docs[r["doc_id"]], r[column]) for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()]


def test_quality_on_held_out_rows():
    rows = labelled_rows("/root/testdata/sf0.01", "quality")
    train, test = rows[: len(rows) * 3 // 4], rows[len(rows) * 3 // 4 :]
    model = quality.fit([t for t, _ in train], np.array([y for _, y in train]))
    score = quality.score_texts(model, [t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((score >= 0.3) == y).mean() >= 0.95 and score[y == 1].min() >= 0.3


def toxic_text(rng, bad):
    words = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(60)]
    if bad:
        for _ in range(3):
            words[rng.integers(60)] = "grob" + "".join(rng.choice(list("xyz"), 3))
    return " ".join(words)


def test_toxic_spans_are_learned_from_document_labels():
    rng = np.random.default_rng(1)
    y = (np.arange(400) % 4 == 0).astype(int)
    texts = [toxic_text(rng, b) for b in y]
    model = toxicity.fit(texts[:300], y[:300])
    score, spans = toxicity.tag_texts(model, texts[300:])
    assert ((score >= 0.3) == y[300:]).mean() >= 0.97
    for text, own, bad in zip(texts[300:], spans, y[300:]):
        if bad and own:
            assert all(text[s:e].startswith("grob") for s, e in own)
    assert sum(bool(s) for s, bad in zip(spans, y[300:]) if bad) >= 20


@pytest.mark.parametrize("width", [6, 3, 2, 1])
def test_marginals_equal_enumeration(width):
    """One document of seven tokens and one of two, in rows of any width: messages cross the rows."""
    rng = np.random.default_rng(3)
    emission, transition = 2 * rng.standard_normal(9), rng.standard_normal((2, 2))
    rows, first = [], []
    for tokens in (range(7), range(7, 9)):
        for k, i in enumerate(range(0, len(tokens), width)):
            own = list(tokens[i : i + width])
            rows.append(own + [-1] * (width - len(own)))
            first.append(k == 0)
    p, expected = toxicity.marginals(emission, np.array(rows), np.array(first), transition)
    one, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 7), (7, 9)):
        n, total, own, moved = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << n):
            s = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(emission[a + i] * s[i] for i in range(n)) + sum(transition[s[i], s[i + 1]] for i in range(n - 1)))
            total += w
            own += w * np.array(s)
            for i in range(n - 1):
                moved[s[i], s[i + 1]] += w
        one[a:b] = own / total
        pairs += moved / total
    assert np.allclose(p, one) and np.allclose(expected, pairs)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_degenerate_training(spark, module):
    docs = odd.docs(spark)
    apply = quality.score if module is quality else toxicity.tag
    for labels in ([], [(1, None)], [(4, 1), (5, 1)], [(4, 0)], [(2, 1), (3, 0), (777, 1)], [(4, 1), (4, 0), (6, 0), (7, 1)]):
        model = module.train(docs, spark.createDataFrame(labels, "doc_id long, label int"))
        found = apply(docs, model).collect()
        assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
        assert apply(odd.empty(spark), model).count() == 0
    assert module.train(odd.empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, label int"))["slope"] == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, label int")
    assert labelled.sample(docs, labels, 50, 10**9).count() == 50
    assert labelled.sample(docs, labels, 150, 1_050).count() == 11
    again = labelled.sample(docs.repartition(7), labels.repartition(3), 50, 10**9)
    assert sorted(labelled.sample(docs, labels, 50, 10**9).collect()) == sorted(again.collect())


def test_platt_with_one_class():
    assert labelled.platt(np.array([1.0, 2.0]), np.array([1, 1]))[0] == 0.0


def test_pipeline_keeps_the_columns_and_only_shrinks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{corpus_pipeline.shared.fresh_path(spark, 'test')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        own = {r.doc_id for r in docs.select("doc_id").collect()}
        assert own <= ids and own
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = own
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_pipeline_stages_on_odd_and_empty_documents(spark, sf_dir):
    for df in (odd.docs(spark), odd.empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, sf_dir)
            assert out.count() <= df.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
