"""Every registered query against its SQL counterpart on the smallest tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spendloom.functions.stemming import stem
from spendloom.functions.text import clean_query, search_tokens
from spendloom.plans import registry
from tests.oracle_check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
LIBRARY = sorted(set(SQL) & set(registry.queries()))


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_counterparts_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
    # what SQL can't express is tested against brute force
    own = {n for n in QUERIES if n not in registry.queries()}
    assert set(QUERIES) - set(SQL) - own == {"ann_recall", "bm25_stemmed"}


@pytest.mark.parametrize("name", LIBRARY)
def test_equal_to_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], SQL[name]) == ""


def test_recall_of_the_approximate_search(spark, sf_dir):
    found = [r["recall"] for r in QUERIES["ann_recall"](spark, sf_dir).collect()]
    assert found
    assert sum(found) / len(found) >= 0.9


def test_stemmed_search_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    asked = {r["item_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}

    def stemmed(frame):
        tokens = frame.select("id", F.explode(search_tokens(F.col("text"))).alias("term"))
        out = {}
        for r in tokens.collect():
            out.setdefault(r["id"], []).append(stem(r["term"]))
        return out

    def frame(texts):
        return spark.createDataFrame(list(texts.items()), "id long, text string")

    words = stemmed(frame(docs))
    questions = stemmed(frame(asked).select("id", clean_query(F.col("text")).alias("text")))
    average = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    found = {}
    for r in QUERIES["bm25_stemmed"](spark, sf_dir).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    assert set(found) == set(questions)
    for q in sorted(questions)[:25]:
        terms, scores = set(questions[q]), Counter()
        for i, w in words.items():
            tf = Counter(w)
            for t in terms & tf.keys():
                idf = math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                scores[i] += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / average))
        best = sorted(((-round(v, 6), i) for i, v in scores.items()))[:20]
        assert [(-round(s, 5), i) for i, s in found[q]] == [(round(s, 5), i) for s, i in best]
