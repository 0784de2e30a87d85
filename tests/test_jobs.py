import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.operators import embedding as emb
from spendloom.operators import telemetry
from spendloom.operators.catalogue import unique_items
from spendloom.plans import registry
from spendloom.plans import testbed as tb
from spendloom.sources import keyed
from spendloom.sources.keyed import KeyedSink
from spendloom.streaming import jobs, ratings
from tests.conftest import rows


def items(spark, n=30):
    text = F.concat(F.lit("word "), F.col("id").cast("string"))
    return spark.range(n).select(
        F.md5(F.col("id").cast("string")).alias("item_id"), text.alias("notice_title"), text.alias("item_name"), F.lit(None).cast("string").alias("item_desc")
    )


def test_embedding_resumes_and_rebuilds(spark, tmp_path):
    path, make = str(tmp_path / "e"), emb.hashing_embedder(16)
    emb.embed_pending(items(spark), path, make, 16, limit=10)
    first = {r["item_id"]: r["embedding"] for r in spark.read.parquet(path).collect()}
    assert len(first) == 10
    assert emb.pending_items(items(spark), spark.read.parquet(path)).count() == 20
    emb.embed_pending(items(spark), path, make, 16)
    emb.embed_pending(items(spark), path, make, 16)
    stored = {r["item_id"]: r["embedding"] for r in spark.read.parquet(path).collect()}
    assert len(stored) == 30 == spark.read.parquet(path).count()
    assert all(stored[k] == v for k, v in first.items())
    assert all(sum(x * x for x in v) == pytest.approx(1, abs=1e-5) for v in stored.values())
    emb.embed_pending(items(spark), path, emb.hashing_embedder(8), 8)
    assert emb.wrong_width(spark.read.parquet(path), 8).count() == 0
    assert spark.read.parquet(path).count() == 30


def test_positions_and_running_totals(spark):
    found = rows(emb.numbered(items(spark, 500)).select("item_id", "position"), "item_id")
    assert [p for _, p in found] == list(range(1, 501))
    frame = spark.range(1, 2501).select(F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    total = 0
    for n, v, t in rows(emb.running_total(frame, "n", {"v": "t"}, block=100).select("n", "v", "t"), "n"):
        total += v
        assert (v, t) == (n % 7, total)


def test_chunk_log(spark):
    log = rows(emb.chunk_log(items(spark, 25), 10), "chunk")
    assert [(r[0], r[1], r[4]) for r in log] == [(1, 10, 10), (2, 10, 20), (3, 5, 25)]
    assert log[-1][5] == sum(r[2] for r in log)
    timed = spark.createDataFrame([(10, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 0, 0, 5))], "items int, started_at timestamp, finished_at timestamp")
    assert emb.with_rate(timed).first()["items_per_second"] == 2.0


def log_rows(spark, *changes):
    base = dict(id=1, timestamp=dt.datetime(2025, 1, 1), query="q", matched_items_count=1, total_spend=1.0, latency_ms=10.0,
                used_vector=0, used_llm=1, feedback=None, prompt_tokens=100, total_tokens=150, cost_usd=0.0)
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], telemetry.LOG_SCHEMA)


def test_log_figures(spark):
    log = log_rows(spark, {}, {"id": 2, "feedback": "thumbs_up", "latency_ms": 30.0}, {"id": 3, "feedback": "thumbs_down"})
    figures = telemetry.key_figures(telemetry.with_cost(log)).first()
    assert figures[:3] == (3, pytest.approx(50 / 3), 450)
    assert figures["total_cost_usd"] == pytest.approx(3 * (100 * 0.075 + 50 * 0.3) / 1e6, abs=1e-6)
    assert figures["satisfaction_rate"] == 50.0
    empty = telemetry.key_figures(log.limit(0)).first()
    assert (empty["total_queries"], empty["avg_latency_ms"], empty["satisfaction_rate"]) == (0, 0.0, 100.0)
    assert rows(telemetry.feedback_split(log)) == [("helpful", 1), ("poor", 1), ("unrated", 1)]
    assert [r["id"] for r in telemetry.recent_queries(log, 2).collect()] == [3, 2]
    assert telemetry.recent_queries(log).first()["feedback"] == "thumbs_down"
    assert telemetry.latest_queries(log).count() == 3
    assert [r["id"] for r in telemetry.latency_series(log).collect()] == [1, 2, 3]
    assert telemetry.cost_by(log, "query").first()["calls"] == 3


def test_latest_feedback_wins(spark):
    log = log_rows(spark, {}, {"id": 2, "feedback": "thumbs_up"})
    given = spark.createDataFrame(
        [(1, "up", dt.datetime(2025, 1, 1)), (1, "No", dt.datetime(2025, 1, 2)), (9, "up", dt.datetime(2025, 1, 2))],
        "log_id long, feedback string, given_at timestamp",
    )
    found = telemetry.with_feedback(log, given)
    assert rows(found.select("id", "feedback"), "id") == [(1, "thumbs_down"), (2, "thumbs_up")]


def test_log_append_and_older_files(spark, tmp_path):
    path = str(tmp_path / "log")
    log_rows(spark, {}).drop("prompt_tokens", "total_tokens", "cost_usd").write.parquet(path)
    telemetry.append_log(log_rows(spark, {"id": 1}, {"id": 2}), path)
    telemetry.append_log(log_rows(spark, {"id": 2}), path)
    assert rows(telemetry.read_log(spark, path).select("id", "prompt_tokens"), "id") == [(1, 0), (2, 100)]


def test_catalogue_stream_equals_batch_and_replays(spark, sf_dir, tmp_path):
    awards = tb.awards(spark, sf_dir)
    awards.repartition(3).write.parquet(str(tmp_path / "awards"))
    stream = lambda: jobs.read_files(spark, str(tmp_path / "awards"), awards.schema, files_per_batch=1)
    for checkpoint in ("c1", "c1", "c2"):
        jobs.run_to_end(jobs.grow_catalogue(stream(), str(tmp_path / "items"), str(tmp_path / checkpoint)))
    stored = KeyedSink(spark, str(tmp_path / "items"), "item_id").read()
    assert rows(stored, "item_id") == rows(unique_items(awards), "item_id")


def test_embed_stream_equals_batch_and_replays(spark, tmp_path):
    source, sink, make = str(tmp_path / "items"), str(tmp_path / "vectors"), emb.hashing_embedder(16)
    items(spark).repartition(3).write.parquet(source)
    for checkpoint in ("c1", "c1", "c2"):
        stream = jobs.read_files(spark, source, items(spark).schema, files_per_batch=2)
        jobs.run_to_end(jobs.embed_new_items(stream, sink, str(tmp_path / checkpoint), make, 16))
    assert rows(emb.read_embeddings(spark, sink), "item_id") == rows(emb.embed(items(spark), make), "item_id")


def test_telemetry_stream_equals_batch_over_many_batches(spark, sf_dir, tmp_path):
    events = tb.table(spark, sf_dir, "events")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = tb.query_log(jobs.read_files(spark, str(tmp_path / "events"), events.schema, files_per_batch=1))
    path = str(tmp_path / "windows")
    jobs.run_to_end(jobs.stream_telemetry(stream, path, str(tmp_path / "c"), lateness="20000 days"))
    streamed = jobs.read_telemetry(spark, path).drop("avg_latency_ms")
    batch = jobs.telemetry_windows(tb.query_log(events)).drop("latency_sum")
    assert rows(streamed, "window_start") == rows(batch, "window_start")
    assert jobs.read_telemetry(spark, path).agg(F.sum("queries")).first()[0] == events.count()


def test_embedding_commits_part_by_part(spark, tmp_path):
    path, calls = str(tmp_path / "parts"), str(tmp_path / "calls")

    def failing():
        make = emb.hashing_embedder(16)()

        def embed(texts):
            with open(calls, "a") as log:
                log.write("x" * len(texts))
            if len(open(calls).read()) > 20:
                raise RuntimeError("the service is gone")
            return make(texts)

        return embed

    with pytest.raises(Exception, match="the service is gone"):
        emb.embed_pending(items(spark), path, failing, 16, chunk=5)
    stored = spark.read.parquet(path).count()
    assert 0 < stored < 30
    emb.embed_pending(items(spark), path, emb.hashing_embedder(16), 16, chunk=5)
    assert spark.read.parquet(path).select("item_id").distinct().count() == 30 == spark.read.parquet(path).count()


def test_many_parts_need_few_jobs(spark, tmp_path):
    path, context = str(tmp_path / "parts"), spark.sparkContext
    context.setJobGroup("many-parts", "")
    emb.embed_pending(items(spark, 200), path, emb.hashing_embedder(16), 16, chunk=2)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("many-parts")) < 60
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("item_id").distinct().count() == 200
    # a part is a commit of its own: far more files than the 64 buckets of one
    assert stored.select(F.input_file_name()).distinct().count() > 80


def test_embed_stream_refuses_another_width(spark, tmp_path):
    source, sink = str(tmp_path / "items"), str(tmp_path / "vectors")
    items(spark).write.parquet(source)
    emb.embed_pending(items(spark, 5), sink, emb.hashing_embedder(8), 8)
    stream = jobs.read_files(spark, source, items(spark).schema)
    with pytest.raises(Exception, match="rebuild them"):
        jobs.run_to_end(jobs.embed_new_items(stream, sink, str(tmp_path / "c"), emb.hashing_embedder(16), 16))
    assert spark.read.parquet(sink).count() == 5


def test_a_new_checkpoint_starts_the_figures_anew(spark, tmp_path):
    source, path = str(tmp_path / "log"), str(tmp_path / "windows")
    for start in (0, 2, 4):
        log_rows(spark, {"id": start}, {"id": start + 1}).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_files(spark, source, telemetry.LOG_SCHEMA, files_per_batch=1)
    jobs.run_to_end(jobs.stream_telemetry(stream, path, str(tmp_path / "c1")))
    assert [r["queries"] for r in jobs.read_telemetry(spark, path).collect()] == [6]
    log_rows(spark, *({"id": k} for k in range(10, 60))).coalesce(1).write.mode("overwrite").parquet(source)
    stream = jobs.read_files(spark, source, telemetry.LOG_SCHEMA)
    jobs.run_to_end(jobs.stream_telemetry(stream, path, str(tmp_path / "c2")))
    assert [r["queries"] for r in jobs.read_telemetry(spark, path).collect()] == [50]


def keyed_rows(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 2).alias("v"))


def test_keyed_sink_stores_each_key_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MERGE_AFTER", 3)
    sink = KeyedSink(spark, str(tmp_path / "sink"), "k", buckets=8, words=64)
    assert sink.read() is None
    nothing = spark.createDataFrame([(None, 1)], "k string, v long")
    for low, high in ((0, 50), (40, 60), (0, 60), (60, 200), (190, 210), (0, 0), (100, 300), (250, 320)):
        sink.append(keyed_rows(spark, low, high).unionByName(keyed_rows(spark, low, high)).unionByName(nothing))
    assert sorted(map(tuple, sink.read().collect())) == sorted((f"k{k}", 2 * k) for k in range(320))
    # Filters are merged, so their number stays under the bound.
    bases, more = sink._filter_folders()
    assert len(bases) == 1 and len(more) < 3


def test_new_keys_are_appended_without_reading_rows(spark, tmp_path):
    path = tmp_path / "sink"
    sink = KeyedSink(spark, str(path), "k")
    for k in range(3):
        sink.append(keyed_rows(spark, 1000 * k, 1000 * k + 300))
    for file in path.glob("key_bucket=*/*.parquet"):
        file.write_bytes(b"no parquet")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert sink.missing(keyed_rows(spark, 5000, 5200)).count() == 200
    with pytest.raises(Exception, match="parquet|Parquet"):
        sink.missing(keyed_rows(spark, 0, 5)).count()


def test_append_that_failed_after_its_filters_is_replayed(spark, tmp_path):
    path = tmp_path / "sink"
    sink = KeyedSink(spark, str(path), "k", buckets=4)
    sink.append(keyed_rows(spark, 0, 40))
    kept = sorted(path.glob("key_bucket=*"))[0].name
    for folder in path.glob("key_bucket=*"):
        if folder.name != kept:
            for file in folder.iterdir():
                file.unlink()
    assert 0 < sink.read().count() < 40
    sink.append(keyed_rows(spark, 0, 40))
    assert sorted(r["k"] for r in sink.read().collect()) == sorted(f"k{k}" for k in range(40))


def given_file(spark, path, *pairs):
    """A file of ratings (log id, rating, day)."""
    data = [(k, f, dt.datetime(2025, 1, 1) + dt.timedelta(days=d)) for k, f, d in pairs]
    spark.createDataFrame(data, "log_id long, feedback string, given_at timestamp").coalesce(1).write.mode("append").parquet(path)


def test_ratings_as_state(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("given", "latest", "c"))

    def run():
        schema = "log_id long, feedback string, given_at timestamp"
        stream = jobs.read_files(spark, source, T._parse_datatype_string(schema), files_per_batch=1)
        jobs.run_to_end(ratings.stream_ratings(stream, path, checkpoint, "10 days", 20, compact_after=3))
        return {r["log_id"]: (r["verdict"], r["given_at"].day) for r in ratings.read_ratings(spark, path).collect()}

    given_file(spark, source, (1, "up", 3), (2, "no", 3), (1, "no", 1), (None, "up", 1))
    given_file(spark, source, (1, "no", 2), (2, "up", 4), (3, "up", 4), (3, "no", 4))
    # Of equal times the greater verdict wins; an earlier rating that comes later changes nothing.
    assert run() == {1: ("thumbs_up", 4), 2: ("thumbs_up", 5), 3: ("thumbs_up", 5)}
    # The state outlives a restart.
    given_file(spark, source, (1, "no", 2), (2, "no", 6))
    assert run() == {1: ("thumbs_up", 4), 2: ("thumbs_down", 7), 3: ("thumbs_up", 5)}
    # A newest rating makes those ten days older late, and lets older states go; what was written stays.
    given_file(spark, source, (4, "up", 25))
    run()
    given_file(spark, source, (3, "no", 10), (4, "no", 26))
    assert run() == {1: ("thumbs_up", 4), 2: ("thumbs_down", 7), 3: ("thumbs_up", 5), 4: ("thumbs_down", 27)}
    # Every third batch leaves one folder.
    assert len(list(Path(path).glob("run=*/epoch=*"))) <= 3


def test_stream_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 50)
    assert registry._in_files(spark.range(1000), str(tmp_path / "many")) == 5
    sizes = spark.read.parquet(str(tmp_path / "many")).groupBy(F.input_file_name()).count()
    assert sizes.count() == 20 and sizes.agg(F.max("count")).first()[0] <= 60
    assert registry._in_files(spark.range(10), str(tmp_path / "few")) == 1
