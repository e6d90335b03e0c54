"""The classifiers' queries over the given tables against their models applied text by text, and what they miss."""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pytest

from brookmart.llm import common, quality, toxicity

DATA = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rest(key, n):
    return zlib.crc32(str(key).encode()) % n


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_quality_query_equals_its_model(spark):
    docs, labels = (common.table(spark, DATA, t) for t in ("documents", "labels"))
    model, texts = quality.train(docs, labels), texts_of(docs)
    got = {r.doc_id: r for r in quality.op2_quality_classifier(spark, DATA).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        score = float(model.score(np.array([quality.features(text.encode())]))[0])
        r = got[k]
        assert math.isclose(r.score, score, abs_tol=1e-9) and 0 <= r.score <= 1
        assert r.held_out == (rest(k, 4) == 2) and r.predicted == int(r.score >= 0.7)


def test_toxicity_query_equals_its_model(spark):
    docs, labels = (common.table(spark, DATA, t) for t in ("documents", "labels"))
    model, texts = toxicity.train(docs, labels), texts_of(docs)
    lexicon, known = toxicity.Lexicon(model.terms), {}
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, DATA).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        x = np.array(toxicity.numbers(*toxicity.hits(text, lexicon, known)))
        r = got[k]
        assert math.isclose(r.score, 1 / (1 + math.exp(-(x @ model.weights[:-1] + model.weights[-1]))), abs_tol=1e-9)
        assert r.held_out == (rest(k, 5) == 0) and r.predicted == int(r.score >= 0.5)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (common.table(spark, DATA, t) for t in ("documents", "labels"))
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if rest(r.doc_id, 4) == 2 else r.quality, 1 - r.toxic if rest(r.doc_id, 5) == 0 else r.toxic) for r in labels.collect()], labels.schema)
    x = np.array([quality.features(t.encode()) for t in texts_of(docs).values()])
    assert (quality.train(docs, labels).score(x) == quality.train(docs, turned).score(x)).all()
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.terms == b.terms and (a.weights == b.weights).all()


@pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in common.table(spark, MORE, "labels").collect()}
    for query, label, least in ((quality.op2_quality_classifier, "quality", 0.95), (toxicity.op8_toxicity, "toxic", 0.93)):
        rows = [r for r in query(spark, MORE).collect() if r.held_out and r.doc_id in labels and labels[r.doc_id][label] is not None]
        right = sum(r.predicted == labels[r.doc_id][label] for r in rows)
        assert len(rows) > 50 and right / len(rows) >= least, (label, right, len(rows))
