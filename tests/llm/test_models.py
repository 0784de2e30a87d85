"""Classifiers by held-out accuracy, and their parts against brute force."""

import binascii

import numpy as np
import pyarrow as pa
import pytest

from spendloom.llm import labelled, language_id, quality, toxicity
from spendloom.llm.queries import op3_language_id, op7_quality, op10_toxicity
from spendloom.llm.textblocks import words

SF = "/root/testdata/sf0.01"


def remainder(i, n):
    return binascii.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def test_words_equal_split_words_in_small_blocks():
    texts = ["", "a", " Two  words\n", "é ß\tx", "long " * 300, None, "\x0b\x0c", "end"]
    column = pa.array(["skipped", *texts])[1:]
    for size in (1, 7, 64, 1 << 20):
        got = [[] for _ in texts]
        for b in words(column, size=size):
            for r, s, e in zip(b.row, b.start, b.end):
                got[r].append(bytes(b.data[s:e]))
        assert got == [(t or "").encode().split() for t in texts]


def test_languages_of_held_out_rows(spark, tables):
    docs, _ = tables
    got = op3_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_profile_equals_the_bundle_of_bound_vectors():
    space = language_id.Space()
    model = language_id.Model({"a": space.bundle(["aaab abab baba"]), "b": space.bundle(["ccd dcdc cdcd"])})
    text = "abab ccdc aab"
    bundle = space.bundle([text])
    cosine = model.prototypes @ bundle
    names, scores = model.predict([text])
    assert names == [model.names[int(cosine.argmax())]]
    row, gram, count, _ = model.space.grams([text])
    assert np.allclose(model._products(gram).T @ count, cosine)


def test_odd_texts_have_a_language_or_none(spark):
    rows = [(1, "the " * 50, "en"), (3, "der " * 50, "de"), (4, None, "en"), (5, "", "de"), (7, "123 !?", "en"), (8, "x", None), (None, "the the the", None), (9, "the der " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.languages(docs).collect()}
    assert {i: got[i].lang_pred for i in (4, 5, 7)} == {4: "und", 5: "und", 7: "und"}
    assert got[8].lang_pred in ("de", "en") and got[9].lang_pred in ("de", "en")
    assert got[None].held_out is False
    assert language_id.languages(docs.limit(0)).collect() == []
    untaught = docs.select("doc_id", "text").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.languages(untaught).collect()} == {"und"}


def test_quality_of_held_out_rows(spark, tables):
    docs, labels = tables
    got = op7_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in got if r.held_out and r.doc_id in labels]) > 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3), (3, "w " * 100_000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.scored(docs, marks).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs.limit(0), labels).collect() == []


def test_toxicity_of_held_out_rows(spark, tables):
    docs, labels = tables
    got = op10_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in got if r.held_out and r.doc_id in labels]) > 0.93


def test_index_finds_the_exact_nearest():
    draw = np.random.default_rng(1)
    n_terms, n = 40, 500
    vectors = []
    for _ in range(n):
        places = np.sort(draw.choice(n_terms, draw.integers(0, 6), replace=False))
        vectors.append((places, draw.integers(1, 4, len(places)).astype(float)))
    index = toxicity.Index(list(range(n)), draw.integers(0, 2, n).astype(float), vectors, draw.random(n_terms) + 0.5)
    dense = np.zeros((len(index.ids), n_terms))
    for e, k in enumerate(index.ids):
        dense[e, vectors[k][0]] = index.weigh(*vectors[k])
    for places, times in vectors[:100]:
        if len(places):
            w = index.weigh(places, times)
            scores = (dense[:, places] @ w).round(12)
            best = sorted(((s, e) for e, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:7]
            got = index.nearest(places, w, 7)
            assert np.allclose([s for s, _ in got], [s for s, _ in best]) and {e for s, e in got if s > got[-1][0] + 1e-9} <= {e for _, e in best}


def test_toxicity_of_odd_rows(spark):
    rows = [(k, f"bad{k % 2} word number{k}" if k % 2 else f"good text number{k}", 0) for k in range(120)]
    rows += [(200, None, 0), (201, "", 0), (201, "", 0), (None, "bad1", 0), (202, "good " * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, evidence int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(200, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert got[None].predicted == 1 and got[200].predicted == got[202].predicted == 0
    assert got[1].evidence and not got[200].evidence
    assert toxicity.scored(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_the_held_out_rows(spark):
    docs = spark.createDataFrame([(k, str(k)) for k in range(50)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "1 as mark").where(labelled.remainder("doc_id", 5) != 0)
    got = labelled.sample(docs, marks, 10).collect()
    assert len(got) == 10 and all(remainder(r.doc_id, 5) for r in got)
