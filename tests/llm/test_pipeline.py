"""The pipeline stage by stage against brute force, on the smallest tables."""

import pyarrow as pa
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from spendloom.llm import quality
from spendloom.llm.queries import queries, table
from spendloom.llm.stored import written
from tests.llm.test_searches import brute_repeats
from tests.llm.test_simhash_components import brute_components, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows by id before the first stage and after each."""
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    out = [("documents", docs.columns, {r.doc_id: r for r in docs.collect()})]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        got = docs.collect()
        out.append((name, docs.columns, {r.doc_id: r for r in got}))
        assert len(got) == len(out[-1][2])
    return sf_dir, out


def test_stages_keep_the_columns(stages):
    _, out = stages
    assert [name for name, _, _ in out[1:]] == [name for name, _ in corpus_pipeline.STAGES]
    assert all(columns == COLUMNS for _, columns, _ in out[:-1])
    assert out[-1][1] == [*COLUMNS, "token_ids", "n_tokens", "lossless"]


def test_rejected_documents_go(spark, stages):
    sf_dir, out = stages
    scores = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()
    assert set(out[1][2]) == {r.doc_id for r in scores if r.score >= 0.3}
    assert all(out[1][2][i].text == out[0][2][i].text for i in out[1][2])


def test_one_document_of_each_group_stays(stages):
    _, out = stages
    before, after = out[1][2], out[2][2]
    roots = brute_components({i: brute_print(r.text) for i, r in before.items()})
    assert set(after) == set(roots.values())


def test_repeated_passages_are_cut(stages):
    _, out = stages
    before, after = out[2][2], out[3][2]
    covered = brute_repeats({i: r.text for i, r in before.items()})
    runs = {}
    for i, r in before.items():
        low = r.text.lower().split()
        runs[i] = {tuple(low[k : k + 5]) for k in range(len(low) - 4)}
    for i, r in before.items():
        words = r.text.split()
        if i not in after:
            # All its words lie in passages whose shingles are those of earlier documents, at 0.8 or more.
            earlier = set().union(*(runs[j] for j in before if j < i))
            assert len(runs[i] & earlier) >= 0.8 * len(runs[i])
        else:
            assert after[i].n_chars == len(after[i].text)
            assert len(after[i].text.split()) <= len(words) - len(covered.get(i, ()))
    assert not brute_repeats({i: r.text for i, r in after.items()})


def test_leaked_documents_go(spark, stages):
    sf_dir, out = stages
    before, after = out[3][2], out[4][2]
    items = [r.text.lower().split() for r in table(spark, sf_dir, "benchmark").collect()]
    for i, r in before.items():
        text = " ".join(r.text.lower().split())
        if any(" ".join(x[k : k + 13]) in text for x in items for k in range(max(1, len(x) - 12))):
            assert i not in after
    texts = {i: " ".join(r.text.lower().split()) for i, r in before.items()}
    for i in set(before) - set(after):
        assert any(" ".join(x[k : k + 4]) in texts[i] for x in items for k in range(len(x) - 3))


def test_tokens_are_the_librarys(stages):
    _, out = stages
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.vocabulary(corpus_pipeline.VOCABULARY))
    assert set(out[5][2]) == set(out[4][2])
    assert all(r.token_ids == model.encode(r.text) and r.lossless for r in out[5][2].values())


def test_registered_names():
    found = entry.queries()
    assert "pipeline" in found and set(queries()) <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "fine words here", "x"), (3, "fine words here", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Null and empty texts are near copies of each other; the least id stays.
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 0), ("3", 3), ("None", 2)]


def test_rows_of_one_id_stay_or_go_each_for_itself(spark, tmp_path):
    leak = "what is the tallest mountain of the world above the sea and who climbed it first"
    clean = ["quiet rivers carry sand to the wide delta every spring", "a lamp burns in the window of the old mill tonight"]
    rows = [(1, leak, "en"), (1, clean[0], "en"), (None, leak, "en"), (None, clean[1], "en"), (2, clean[0], "de"), (2, clean[0], "aa"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.without_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if r[1] != leak], key=str)
    got = corpus_pipeline.one_of_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, clean[0], "en"), (1, leak, "en"), (None, clean[1], "en"), (3, None, "x")], key=str)
    again = docs.where("doc_id = 2")
    assert [tuple(r) for r in corpus_pipeline.one_of_near_copies(spark, again, str(tmp_path)).collect()] == [(2, clean[0], "aa")]


def test_stages_get_few_texts_at_a_time(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    def stage(session, docs, sf_dir):
        return docs.select("text").coalesce(1).mapInArrow(sizes, "n bigint")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", stage)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r.n for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()]
    assert sum(got) == 1000 and max(got) <= corpus_pipeline.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
