import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendloom.functions.stemming import stem
from spendloom.functions.text import english_stop_words
from spendloom.operators import block_postings, fusion, spend, vector_cells, vector_search
from spendloom.operators import text_index as ti
from spendloom.plans import testbed
from tests.conftest import rows

DOCS = [
    ("a", "Bond paper A4 70gsm"),
    ("b", "Bond paper, long bond paper"),
    ("c", "Paper clips and the paper"),
    ("d", "Diesel fuel"),
    ("e", "of the and"),
    ("f", None),
]


def corpus(spark):
    return spark.createDataFrame(DOCS, "item_id string, text string")


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "query_id int, query_text string")


def brute_bm25(query):
    """Scores by the textbook formula over the tokenised documents."""
    stop = {"a", "of", "the", "and"}
    docs = {k: [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if w not in stop] for k, t in DOCS}
    lengths = [len(d) for d in docs.values() if d]
    average = sum(lengths) / len(lengths)
    scores = Counter()
    for term in set(query.lower().split()):
        df = sum(term in d for d in docs.values())
        for key, words in docs.items():
            tf = words.count(term)
            if tf:
                idf = math.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
                scores[key] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
    return {k: round(v, 6) for k, v in scores.items()}


@pytest.mark.parametrize("query", ["bond paper", "paper", "diesel paper", "zebra"])
def test_bm25_equals_the_formula(spark, query):
    index = ti.build_index(corpus(spark), ["text"])
    found = ti.keyword_search(index, asked(spark, (1, query)), 10).collect()
    assert {r["item_id"]: r["score"] for r in found} == brute_bm25(query)
    assert all(r["score"] > 0 for r in found)
    assert sorted(r["rank"] for r in found) == list(range(1, len(found) + 1))


def test_empty_and_symbol_queries_find_nothing(spark):
    index = ti.build_index(corpus(spark), ["text"])
    assert ti.keyword_search(index, asked(spark, (1, "?!"), (2, "70"), (3, None)), 5).count() == 0


def test_scope_applies_before_the_cut(spark):
    index = ti.build_index(corpus(spark), ["text"])
    scope = spark.createDataFrame([("c",), ("c",)], "item_id string")
    found = ti.keyword_search(index, asked(spark, (1, "paper")), 1, scope).collect()
    assert [(r["item_id"], r["rank"]) for r in found] == [("c", 1)]


def test_stored_index_gives_the_same(spark, tmp_path):
    index = ti.build_index(corpus(spark), ["text"], partitions=4)
    ti.write_index(index, str(tmp_path))
    stored = ti.read_index(spark, str(tmp_path))
    queries = asked(spark, (1, "bond paper"), (2, "fuel paper"))
    mine, theirs = (ti.keyword_search(i, queries, 5) for i in (index, stored))
    assert rows(mine, "query_id", "rank") == rows(theirs, "query_id", "rank")
    plan = theirs._jdf.queryExecution().executedPlan().toString()
    # Only partitions of asked terms are read, and no rows of (query, item) are dealt.
    assert "dynamicpruning" in plan and "hashpartitioning(query_id, item_id" not in plan


def block_table(seed, n_items, terms, block=16):
    """Blocks of random postings, and the contribution of every (term, item)."""
    random = np.random.default_rng(seed)
    blocks, parts = [], {}
    for term in terms:
        docs = np.flatnonzero(random.random(n_items) < random.choice([0.02, 0.3, 0.9]))
        idf = float(random.choice([0.1, 1.0, 5.0]))
        # Few distinct values make ties.
        values = random.choice([0.25, 0.5, 1.5, 2.0], len(docs)) if seed % 2 else random.random(len(docs))
        parts |= {(term, int(d)): float(v) * idf for d, v in zip(docs, values)}
        for at in range(0, len(docs), block):
            d, v = docs[at : at + block], values[at : at + block]
            blocks.append({"term": term, "idf": idf, "docs": d.tolist(), "ids": [f"i{x:05}" for x in d], "parts": v.tolist(), "top": float(v.max())})
    random.shuffle(blocks)
    kinds = pa.schema([("term", pa.string()), ("idf", pa.float64()), ("docs", pa.list_(pa.int32())), ("ids", pa.list_(pa.string())), ("parts", pa.list_(pa.float64())), ("top", pa.float64())])
    return pa.Table.from_pylist(blocks, kinds), parts


@pytest.mark.parametrize("seed", range(12))
def test_blocks_rank_as_brute_force(seed):
    terms = [f"t{k}" for k in range(8)]
    table, parts = block_table(seed, 900, terms)
    random = np.random.default_rng(seed)
    allowed = None if seed % 3 else [f"i{x:05}" for x in range(900) if x % 7 < 3]
    bucket = block_postings.Bucket(table, None if allowed is None else pa.array(allowed))
    for _ in range(30):
        names = [str(t) for t in random.choice([*terms, "absent"], random.integers(1, 7), replace=False)]
        k = int(random.choice([1, 3, 20, 2000]))
        scores = Counter()
        for (term, doc), part in parts.items():
            if term in names and (allowed is None or f"i{doc:05}" in allowed):
                scores[doc] += part
        best = sorted(((-round(v, 6), d) for d, v in scores.items()))[:k]
        docs, found = bucket.best(names, k)
        assert [(round(-s, 6) + 0.0, int(d)) for s, d in zip(found, docs)] == [(round(s, 6) + 0.0, d) for s, d in best]
        assert bucket.ids_of(names, docs) == [f"i{d:05}" for d in docs]


def test_blocks_under_the_kth_score_are_skipped():
    blocks = [{"term": "rare", "idf": 9.0, "docs": [5, 700], "ids": ["a", "b"], "parts": [1.0, 2.0], "top": 2.0}]
    for at in range(0, 1000, 10):
        blocks.append({"term": "common", "idf": 0.1, "docs": list(range(at, at + 10)), "ids": ["x"] * 10, "parts": [1.0] * 10, "top": 1.0})
    bucket = block_postings.Bucket(pa.Table.from_pylist(blocks))
    docs, scores = bucket.best(["common", "rare"], 1)
    # Of a hundred blocks of the common term only the best item's is looked into.
    assert (docs.tolist(), scores.tolist(), bucket.opened) == ([700], [18.1], 2)


def test_many_queries_and_buckets_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(block_postings, "QUERY_ROWS", 7)
    monkeypatch.setattr(block_postings, "BLOCK", 4)
    monkeypatch.setattr(ti, "BUCKET_TOKENS", 300)
    random = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("ak", "el", "ux")]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(random.choice(words, random.integers(1, 12), p=weights / weights.sum())) for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    queries = [(q, " ".join(random.choice(words, 3))) for q in range(40)] + [(40, "zzz"), (41, "")]
    index = ti.build_index(items, ["text"], partitions=2)
    assert index.stats.first()["buckets"] > 4
    ti.write_index(index, str(tmp_path))
    docs = [t.split() for t in texts]
    average = sum(map(len, docs)) / len(docs)
    expected = {}
    for q, text in queries:
        scores = Counter()
        for term in set(text.split()):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                if tf := d.count(term):
                    scores[i] += math.log((300 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
        if scores:
            expected[q] = sorted((-round(v, 6), i) for i, v in scores.items())[:6]
    found = {}
    for r in ti.keyword_search(ti.read_index(spark, str(tmp_path)), spark.createDataFrame(queries, "query_id int, query_text string"), 6).collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["item_id"]))
    assert {q: sorted(v) for q, v in found.items()} == expected


def vectors(spark, n=400, width=8, copies=0, seed=3):
    random = np.random.default_rng(seed)
    data = random.normal(size=(n, width)).astype(np.float32)
    data[:copies] = data[0]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "item_id long, embedding array<float>")
    return data.astype(np.float64), frame.repartition(5)


def brute_cosine(data, queries, k):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    wanted = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    scores = np.round(wanted @ unit.T, 6)
    return [sorted(range(len(data)), key=lambda i, s=s: (-s[i], i))[:k] for s in scores]


def self_queries(frame):
    return frame.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@pytest.mark.parametrize("copies", [0, 150])
def test_cosine_equals_brute_force_over_the_whole_table(spark, copies):
    data, frame = vectors(spark, copies=copies)
    found = vector_search.vector_search(frame, self_queries(frame), 7).collect()
    lists = {q: [] for q in range(len(data))}
    for r in sorted(found, key=lambda r: r["rank"]):
        lists[r["query_id"]].append(r["item_id"])
    assert list(lists.values()) == brute_cosine(data, data, 7)
    assert all(r["score"] > 0.9999 for r in found if r["rank"] == 1)


def test_more_queries_than_a_block(spark, monkeypatch):
    data, frame = vectors(spark)
    whole = rows(vector_search.vector_search(frame, self_queries(frame), 3), "query_id", "rank")
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 64)
    assert rows(vector_search.vector_search(frame, self_queries(frame), 3), "query_id", "rank") == whole


def test_many_queries_of_one_id_are_split(spark, monkeypatch):
    data, frame = vectors(spark)
    queries = self_queries(frame).withColumn("query_id", F.lit(1).cast("bigint"))
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 4)
    few = queries.limit(6)
    found = vector_search.vector_search(frame, few.unionByName(few), 1).collect()
    assert len(found) == 1 and found[0]["rank"] == 1


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("gloves", "glove"), ("glove", "glove"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"),
        ("conflated", "conflat"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("adoption", "adopt"), ("replacement", "replac"),
        ("controlling", "control"), ("rolling", "roll"), ("rate", "rate"), ("cease", "ceas"), ("is", "is"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_stemmed_search_finds_other_forms(spark):
    items = spark.createDataFrame([("a", "surgical gloves"), ("b", "glove boxes and boxing"), ("c", "cement")], "item_id string, text string")
    plain = ti.build_index(items, ["text"])
    queries = spark.createDataFrame([(1, "the glove")], "query_id int, query_text string")
    assert [r["item_id"] for r in ti.keyword_search(plain, queries, 5).collect()] == ["b"]
    index = ti.stemmed(plain)
    assert {r["item_id"] for r in ti.keyword_search(index, queries, 5, stemming=True).collect()} == {"a", "b"}
    assert {r["term"]: r["df"] for r in index.terms.collect()}["glove"] == 2
    assert "ourselves" in english_stop_words() and len(english_stop_words()) > 150


def test_stemmed_index_stems_its_words_once(spark):
    items = spark.createDataFrame([("a", "boxes boxing boxed"), (None, "a box"), ("a", "boxes boxing boxed")], "item_id string, text string")
    index = ti.stemmed(ti.build_index(items, ["text"]))
    assert sorted((r["item_id"] or "", r["term"], r["tf"]) for r in index.postings.collect()) == [("", "box", 1), ("a", "box", 6)]
    # weights and searches read the written postings
    assert all("ArrowEvalPython" not in df._jdf.queryExecution().toString() for df in (index.postings, index.terms))


def test_vectors_without_length_and_scope(spark):
    frame = spark.createDataFrame(
        [("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), ("d", [0.0, 2.0])], "item_id string, embedding array<float>"
    )
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "query_id int, query_vector array<float>")
    found = vector_search.vector_search(frame, queries, 5)
    assert [r[:2] for r in rows(found, "query_id", "rank")] == [(1, "b"), (1, "d")]
    scope = spark.createDataFrame([("d",)], "item_id string")
    assert [r["item_id"] for r in vector_search.vector_search(frame, queries, 1, scope).collect()] == ["d"]
    assert vector_search.vector_search(frame, queries.filter("query_id = 2"), 5).count() == 0


def test_unequal_widths_are_an_error(spark):
    frame = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "item_id string, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, query_vector array<float>")
    with pytest.raises(Exception, match="width"):
        vector_search.vector_search(frame, queries, 5).collect()


def test_approximate_search_with_all_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_SLICE_ROWS", 40)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 30)
    data, frame = vectors(spark)
    queries = self_queries(frame).filter("query_id < 20")
    cells = vector_search.train_cells(frame, 5)
    exact = vector_search.vector_search(frame, queries, 6)
    every = vector_search.approximate_search(frame, queries, cells, 6, probes=len(cells))
    assert rows(every, "query_id", "rank") == rows(exact, "query_id", "rank")
    some = vector_search.recall(vector_search.approximate_search(frame, queries, cells, 6, probes=2), exact)
    assert 0.3 < some.agg(F.avg("recall")).first()[0] <= 1.0


def ranked(spark, source, *entries):
    return spark.createDataFrame(
        [(q, i, s, r, source) for q, i, s, r in entries], "query_id int, item_id string, score double, rank int, source string"
    )


def test_tiles_on_both_sides_equal_one_tile(spark, monkeypatch):
    data, frame = vectors(spark, copies=60)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(vector_search, "CORPUS_ROWS", 90)
    found = vector_search.vector_search(frame, self_queries(frame), 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert [got[i] for i in range(len(data))] == brute_cosine(data, data, 4)


def garbled(path, cells):
    """Overwrite the files of all cells but ``cells``, so that reading one fails."""
    spoiled = 0
    for folder in Path(f"{path}/vectors").glob("cell=*"):
        if int(folder.name.split("=")[1]) not in cells:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no parquet")
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
                spoiled += 1
    return spoiled


def test_stored_cells_are_exact_when_all_are_probed_and_grow(spark, tmp_path):
    data, frame = vectors(spark)
    path = str(tmp_path)
    vector_cells.write_cells(frame.where("item_id < 300"), path, 8)
    more = frame.where("item_id >= 250")
    for _ in range(2):
        vector_cells.add_vectors(more.unionByName(more), path)
    assert spark.read.parquet(f"{path}/vectors").count() == 3 * len(data)
    queries = self_queries(frame)
    every = vector_cells.search_cells(spark, path, queries, 6, probes=8).select("query_id", "item_id", "score", "rank")
    exact = vector_search.vector_search(frame, queries, 6).select("query_id", "item_id", "score", "rank")
    assert rows(every, "query_id", "rank") == rows(exact, "query_id", "rank")
    scope = frame.where("item_id % 3 = 0")
    scoped = vector_cells.search_cells(spark, path, queries, 6, probes=8, scope=scope)
    assert rows(scoped, "query_id", "rank") == rows(vector_search.vector_search(frame, queries, 6, scope), "query_id", "rank")


def test_copies_of_a_vector_are_scored_once_when_all_cells_are_probed(spark, tmp_path, monkeypatch):
    data, frame = vectors(spark)
    vector_cells.write_cells(frame.unionByName(frame.where("item_id % 2 = 0")), str(tmp_path), 8)
    read = []

    def search(cells, asked, k):
        read.append(cells.count())
        return vector_search.cell_search(cells, asked, k)

    monkeypatch.setattr(vector_cells, "cell_search", search)
    queries = self_queries(frame.limit(50))
    found = vector_cells.search_cells(spark, str(tmp_path), queries, 6, probes=8).select("query_id", "item_id", "score", "rank")
    exact = vector_search.vector_search(frame, queries, 6).select("query_id", "item_id", "score", "rank")
    assert rows(found, "query_id", "rank") == rows(exact, "query_id", "rank")
    # All three copies were scored before, of rows that come twice too.
    assert read == [len(data)]


@pytest.mark.parametrize(("n", "k"), [(3, 5), (1024, 1), (1025, 7), (6000, 20)])
def test_products_in_single_precision_lose_no_item(n, k):
    """Many vectors are equal or nearly so."""
    draw = np.random.default_rng(n)
    some = draw.normal(size=(n // 50 + 2, 64))
    items = np.resize(some, (n, 64)) + draw.choice([0, 1e-9, 1e-7, 1e-5], size=(n, 1))
    asked = draw.normal(size=(300, 64))
    asked[:200] = items[draw.integers(0, n, 200)]
    items, asked, ids = vector_search._unit(items), vector_search._unit(asked), draw.permutation(n)
    query, item, score = vector_search._top_by_bounds(items, asked, ids, k)
    scores = np.round(asked @ items.T, vector_search.SCORE_DIGITS) + 0.0
    best = [np.lexsort((ids, -row))[:k] for row in scores]
    assert query.tolist() == np.repeat(np.arange(300), min(n, k)).tolist()
    assert item.tolist() == np.concatenate(best).tolist()
    assert score.tolist() == [scores[q, i] for q, i in zip(query, item)]


def test_only_probed_cells_are_read(spark, tmp_path):
    data, frame = vectors(spark)
    path = str(tmp_path)
    vector_cells.write_cells(frame, path, 12)
    centroids = vector_cells.read_centroids(spark, path).unit
    probed = set(np.argsort(-(data[5] @ centroids.T))[:3].tolist())
    query = self_queries(frame.where("item_id = 5"))
    before = rows(vector_cells.search_cells(spark, path, query, 5, probes=3), "rank")
    assert garbled(path, probed) >= 9
    assert rows(vector_cells.search_cells(spark, path, query, 5, probes=3), "rank") == before
    with pytest.raises(Exception, match="parquet|Parquet"):
        vector_cells.search_cells(spark, path, query, 5, probes=12).collect()


def test_recall_at_a_quarter_of_the_cells(spark, tmp_path, sf_dir):
    """Every vector of the table is a query."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    vector_cells.write_cells(table, str(tmp_path), 64)
    near = vector_cells.search_cells(spark, str(tmp_path), self_queries(table), 10, probes=16)
    found = vector_search.recall(near, vector_search.vector_search(table, self_queries(table), 10))
    assert found.agg(F.avg("recall"), F.count("*")).first()[0] >= 0.9


def test_vectors_without_an_item_take_no_rank(spark):
    items = spark.createDataFrame([("a", "bond paper"), ("c", "paper clips")], "item_id string, text string")
    both = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.0]), ("c", [0.9, 0.1])], "item_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, "zebra", [1.0, 0.0])], "query_id int, query_text string, query_vector array<float>")
    result = fusion.hybrid_search(ti.build_index(items, ["text"]), both, queries, awards(spark), 1, catalogue=items)
    assert [r["item_id"] for r in result.items.collect()] == ["c"]


def test_fusion_order_ties_and_metadata(spark):
    vector = ranked(spark, "vector", (1, "x", 0.9, 1), (1, "y", 0.8, 2), (2, "v", 0.7, 1))
    keyword = ranked(spark, "keyword", (1, "z", 5.0, 1), (1, "y", 4.0, 2), (3, "w", 3.0, 1))
    fused = rows(fusion.reciprocal_rank_fusion(vector, keyword, 10), "query_id", "final_rank")
    assert [(r[0], r[1], r[2]) for r in fused] == [(1, "y", 1), (1, "x", 2), (1, "z", 3), (2, "v", 1), (3, "w", 1)]
    scores = [r[3] for r in fused]
    assert scores[0] == pytest.approx(2 / 62)
    assert scores[1] == scores[2] == pytest.approx(1 / 61)
    assert scores[3:] == [None, None]
    assert (fused[0][4], fused[0][5]) == (0.8, "vector")
    assert (fused[2][4], fused[2][5]) == (5.0, "keyword")
    assert fusion.reciprocal_rank_fusion(vector, keyword, 1).count() == 3


AWARDS = "item_id string, agency string, region string, contract_amount decimal(15,2), award_ref string, awardee string, award_date date, notice_title string, item_name string"


def awards(spark):
    data = [
        ("a", "Health", "NCR", "100", "1"), ("a", "Health", "Region VII", "50", "2"), ("b", "Works", "NCR", "300", "3"),
        ("c", "Works", None, "7", "4"), ("d", "Health", "NCR", "1", "5"), (None, "Health", "NCR", "1000", "6"),
    ]
    frame = spark.createDataFrame([(i, g, r, m, f) for i, g, r, m, f in data], "item_id string, agency string, region string, m string, award_ref string")
    return frame.select(
        "item_id", "agency", "region", F.col("m").cast("decimal(15,2)").alias("contract_amount"), "award_ref",
        F.lit("ACME").alias("awardee"), F.lit("2025-01-02").cast("date").alias("award_date"),
        F.lit("t").alias("notice_title"), F.lit("n").alias("item_name"),
    )


def test_spend_of_items_and_filters(spark):
    items = spark.createDataFrame([("a",), ("c",)], "item_id string")
    report = spend.spend_report(awards(spark), items)
    assert rows(spend.totals(report)) == [(157.0, 3, pytest.approx(157 / 3))]
    agencies = [(r["name"], r["award_count"], r["spend"]) for r in report.filter("section='agency'").orderBy("position").collect()]
    assert agencies == [("Health", 2, 150.0), ("Works", 1, 7.0)]
    assert rows(spend.totals(spend.spend_report(awards(spark), region="ncr"))) == [(1401.0, 4, 350.25)]
    assert rows(spend.totals(spend.spend_report(awards(spark), items.limit(0), region="ncr"))) == [(1401.0, 4, 350.25)]
    assert rows(spend.totals(spend.spend_report(awards(spark)))) == [(0.0, 0, 0.0)]
    assert rows(spend.totals(spend.spend_report(awards(spark), agency="nobody"))) == [(0.0, 0, 0.0)]


def hybrid(spark, queries, **scope):
    items = spark.createDataFrame([("a", "bond paper"), ("b", "asphalt road"), ("c", "paper clips"), ("d", "fuel")], "item_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("d", [1.0, 1.0])], "item_id string, embedding array<float>")
    return fusion.hybrid_search(ti.build_index(items, ["text"]), vectors, queries, awards(spark), 2, **scope)


def test_hybrid_pool_is_wider_than_the_list(spark):
    queries = spark.createDataFrame([(1, "paper", [1.0, 0.0]), (2, " ", [1.0, 0.0])], "query_id int, query_text string, query_vector array<float>")
    result = hybrid(spark, queries)
    assert [r[:3] for r in rows(result.items, "query_id", "final_rank")] == [(1, "a", 1), (1, "d", 2)]
    assert rows(result.pool, "query_id", "item_id") == [(1, "a"), (1, "b"), (1, "c"), (1, "d")]
    assert rows(spend.totals(result.spend, ["query_id"]), "query_id") == [(1, 458.0, 5, 91.6), (2, 0.0, 0, 0.0)]
    assert [r["award_ref"] for r in result.samples.orderBy("position").collect()] == ["1", "2", "5"]


def test_no_candidates_fall_back_to_the_filter(spark):
    queries = spark.createDataFrame([(1, "zebra", [0.0, 0.0]), (2, "fuel", [0.0, 0.0])], "query_id int, query_text string, query_vector array<float>")
    result = hybrid(spark, queries, region="ncr")
    assert rows(spend.totals(result.spend, ["query_id"]), "query_id") == [(1, 1401.0, 4, 350.25), (2, 1.0, 1, 1.0)]
    assert [r["award_ref"] for r in result.samples.filter("query_id = 1").orderBy("position").collect()] == ["6", "3", "1", "5"]


def test_summary_text(spark):
    queries = spark.createDataFrame([(1, "paper", [1.0, 0.0]), (2, "zebra", [0.0, 0.0])], "query_id int, query_text string, query_vector array<float>")
    result = hybrid(spark, queries)
    text = {r["query_id"]: r["summary"] for r in spend.summary_text(result.spend, result.samples, queries).collect()}
    assert text[2] == "No contracts match 'zebra'."
    assert text[1].splitlines()[:3] == ["Spend for 'paper'", "Total: ₱458.00 over 5 contracts", "Mean: ₱91.60"]
    assert "- Works: ₱307.00 (2 awards)" in text[1]
    details = spark.createDataFrame(
        [(1, 2, "dddddddddd", "Fuel", "t", "d", "15", "Oil"), (1, 1, "aaaaaaaaaa", "Paper", "t", None, "14", "Paper")],
        "query_id int, final_rank int, item_id string, item_name string, notice_title string, item_desc string, unspsc_code string, unspsc_desc string",
    )
    summaries = spend.summary_text(result.spend, result.samples, queries)
    context = {r["query_id"]: r["context"] for r in spend.context_text(summaries, details).collect()}
    assert context[1] == text[1] + "\nMatched items:\n1. aaaaaaaa | Paper | t | Paper\n2. dddddddd | Fuel | t | Oil | d"
    assert context[2] == text[2]


def test_vectors_move_to_few_tiles(spark):
    def blocks(n, rows):
        return spark.range(n).select(vector_search._tiles(rows)).first()[0]

    many = 1_000_000
    # a vector moves once per block of the other side
    assert blocks(many, vector_search.BLOCK_ROWS) + blocks(many, vector_search.CORPUS_ROWS) < 100
    assert blocks(100_000, vector_search.BLOCK_ROWS) == blocks(20_000, vector_search.BLOCK_ROWS) == 8
    assert [blocks(n, vector_search.CORPUS_ROWS) for n in (0, 1, 3000)] == [1, 1, 2]


def test_part_vectors_are_not_broadcast(spark, sf_dir):
    """What is broadcast goes through the driver; the parts' texts are larger than their files tell."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (testbed.item_embeddings(spark, sf_dir), testbed.label_queries(spark, sf_dir)):
            assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
