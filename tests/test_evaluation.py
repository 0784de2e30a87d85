import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import evaluation as ev
from spendloom.operators import substring_match
from tests.conftest import rows

ITEMS = "item_id string, notice_title string, item_name string, item_desc string, unspsc_code string, unspsc_desc string"


def catalogue(spark):
    return spark.createDataFrame(
        [
            ("1", "Supply and delivery of office bond paper for the year", "Bond Paper A4", "white paper", "14", "Paper"),
            ("2", "Fuel", "Fuel", "Diesel fuel for all the vehicles of the agency in 2025", "15", "Petroleum"),
            ("3", "Same", "same", None, None, None),
            ("4", "Repair of the old road to town", "NULL", None, None, ""),
            ("5", "Long list of many different words here", "Pens", "four words are enough here", None, "pens"),
        ],
        ITEMS,
    )


def test_questions_follow_the_templates(spark):
    found = {r["item_id"]: r["q"] for r in catalogue(spark).select("item_id", ev.item_questions().alias("q")).collect()}
    assert found["1"] == ["Procurement of Bond Paper A4", "Supply and delivery of office bond"]
    assert found["2"] == ["Procurement of Fuel", "Fuel Petroleum"]
    assert found["3"] == ["Procurement of same"]
    assert found["4"] == ["Repair of the old road to"]
    assert found["5"] == ["Procurement of Pens", "Long list of many different words"]


def test_ground_truth(spark):
    embedded = spark.createDataFrame([("1",), ("2",), ("4",)], "item_id string")
    truth = ev.build_ground_truth(catalogue(spark), embedded, 10)
    made = truth.groupBy("source").count()
    assert rows(made, "source") == [("hand-written", 2), ("templated", 4)]
    hand = {r["question"]: r["target_item_id"] for r in truth.filter("source = 'hand-written'").collect()}
    assert hand == {
        "Bond Paper A4 70gsm office supplies": "1",
        "Diesel fuel gasoline procurement for government vehicles": "2",
    }
    assert ev.templated_questions(catalogue(spark), embedded, 1).select("target_item_id").distinct().count() == 1


def test_sample_is_stable(spark):
    frame = spark.range(1000).repartition(7)
    first, again = (rows(ev.stable_sample(frame, "id", 20)) for _ in range(2))
    assert first == again
    assert len(first) == 20
    assert rows(ev.stable_sample(frame, "id", 20, "other")) != first
    assert ev.random_sample(frame, 9, 3).count() == 9


def test_enriched_sample_skips_done_items(spark):
    best = spark.createDataFrame(
        [("1", "DOH", "NCR", "ACME", "9", 5.0), ("2", "DOH", None, "ACME", "8", None)],
        "item_id string, agency string, region string, awardee string, award_ref string, contract_amount double",
    )
    embedded = catalogue(spark).select("item_id")
    done = spark.createDataFrame([("1",)], "item_id string")
    found = ev.enriched_sample(catalogue(spark), embedded, best, done).collect()
    assert [(r["item_id"], r["region"], r["amount"], r["category"]) for r in found] == [("2", "", 0.0, "Petroleum")]


def test_enriched_sample_stops_at_its_size(spark):
    names = spark.range(40).selectExpr(
        "cast(id as string) item_id", "'long title' notice_title", "'long name' item_name", "'' item_desc", "'' unspsc_desc"
    )
    best = names.selectExpr("item_id", "'A' agency", "'R' region", "'W' awardee", "'1' award_ref", "1.0D contract_amount")
    for done, size in ((0, 5), (3, 2), (7, 0)):
        asked = names.orderBy("item_id").limit(done)
        assert ev.enriched_sample(names, names, best, asked, sample_size=5).count() == size


def test_retrieval_metrics_count_misses(spark):
    schema = "query_id int, item_id string, score double, rank int, source string"
    keyword = spark.createDataFrame([(1, "a", 2.0, 1, "keyword"), (2, "b", 1.0, 1, "keyword")], schema)
    vector = spark.createDataFrame([(1, "b", 0.9, 1, "vector"), (1, "a", 0.8, 2, "vector"), (3, "c", 0.7, 6, "vector")], schema)
    targets = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (4, "d")], "query_id int, target_item_id string")
    found = {r["strategy"]: r[1:] for r in ev.retrieval_metrics(keyword, vector, targets).collect()}
    assert found == {"keyword": (4, 0.25, 0.25), "vector": (4, 0.25, 0.125), "hybrid": (4, 0.25, 0.25)}


def test_answer_scorecard(spark):
    scores = spark.createDataFrame([(5, 5, 5), (4, 5, 3)], "faithfulness int, relevance int, completeness int")
    found = {r["dimension"]: (r["questions"], r["mean_score"], r["passed"]) for r in ev.answer_scorecard(scores).collect()}
    assert found == {
        "faithfulness": (2, 4.5, True),
        "relevance": (2, 5.0, True),
        "completeness": (2, 4.0, True),
        "overall": (2, 4.5, True),
    }
    assert ev.score_answers(scores).agg(F.max("overall")).first()[0] == pytest.approx(5.0)


def test_mean_latency(spark):
    timings = spark.createDataFrame([("keyword", 1, 10.0), ("keyword", 2, 30.0)], "strategy string, query_id int, latency_ms double")
    assert rows(ev.mean_latency(timings)) == [("keyword", 20.0)]


def test_many_terms_equal_a_brute_force_join(spark, monkeypatch):
    monkeypatch.setattr(substring_match, "LOT_TERMS", 3000)
    monkeypatch.setattr(substring_match, "BLOCK_ITEMS", 150)
    draw = random.Random(3)
    letters = "abAB éÉ."
    texts = [(f"i{k:03}", None if k % 9 == 0 else "".join(draw.choice(letters) for _ in range(draw.randint(0, 30))), draw.choice([None, "", "Ab é"])) for k in range(400)]
    texts += [(None, "ab", "ab"), ("i000", "ab", None)]
    terms = list({"".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(24_000)})
    assert len(terms) >= 10_000
    terms += ["", None, "AB", "ab"]
    items = spark.createDataFrame(texts, "item_id string, a string, b string")
    found = substring_match.first_matches(items, spark.createDataFrame([(t,) for t in terms], "term string"), ["a", "b"])
    expected = {}
    for term in {t.lower() for t in terms if t is not None}:
        hits = [i for i, a, b in texts if i is not None and any(t is not None and term in t.lower() for t in (a, b))]
        if hits:
            expected[term] = (min(hits), len(hits))
    assert {r["term"]: (r["item_id"], r["matches"]) for r in found.collect()} == expected
