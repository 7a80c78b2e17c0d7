import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import labelled, quality, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = np.random.default_rng(5)
    words = ["table", "river", "green", "walk", "paper", "stone", "quiet", "morning", "idea", "music"]
    docs, labels = [], []
    for i in range(400):
        text = " ".join(rnd.choice(words, 60))
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            text += " you stupid idiot, you loser"
        if poor:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label", "folds", "held", "bar"), [(toxicity.score, "toxic", 5, 0, 0.5), (quality.score, "quality", 4, 2, 0.7)])
def test_held_out_rows(corpus, score, label, folds, held, bar):
    docs, labels = corpus
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= bar)
    outside = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in outside]) > 0.95


@pytest.mark.parametrize("score", [toxicity.score, quality.score])
def test_messy_rows(spark, messy, nothing, corpus, score):
    _, labels = corpus
    odd = labels.limit(3).unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None)], labels.schema)).unionByName(labels.limit(2))
    for known in (labels, odd, labels.limit(0)):
        rows = score(messy, known).collect()
        assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert score(nothing, labels).count() == 0


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    w, bias = quality.dual_descent(rows, np.array([1.0, 1.0, -1.0, -1.0]), np.ones(3), np.ones(4), epochs=200)
    assert [np.sign(w[r].sum() + bias) for r in rows] == [1, 1, -1, -1]
    assert abs(w[0] + w[1]) < 1e-2


def test_features():
    values = toxicity.features("You are a MORON!! An id1ot, morning", frozenset(["morning"]), frozenset(["morni"]))
    assert len(values) == toxicity.FEATURES
    assert values[0] > 0 and values[2] > 0 and values[4] > 0 and values[6] > 0 and values[13] > 0
    assert toxicity.features("", frozenset(), frozenset()) == [0.0] * toxicity.FEATURES
    assert quality.shape("THE!!!!") == "X!!" and quality.shape("Él,") == "Xx," and quality.shape("ab12") == "x9"


def test_sample_has_one_row_for_each_key(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(300)] + [(2, None), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    drawn = [sorted(map(tuple, labelled.sample(d, labels, "quality", F.lit(True), 3).collect())) for d in (docs, docs.repartition(7))]
    assert drawn[0] == drawn[1] and [(r[0], r[2]) for r in drawn[0]] == [(1, 1.0), (2, 0.0), (3, 1.0)]
    assert len(labelled.sample(docs, labels, "quality", F.lit(True), 2).collect()) == 2
