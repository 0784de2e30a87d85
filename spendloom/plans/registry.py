"""Registered queries: each takes (spark, sf_dir) and returns a frame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.functions.text import contains_ci, table_prefix
from spendloom.operators import analytics as an
from spendloom.operators import catalogue as cat
from spendloom.operators import embedding as emb
from spendloom.operators import evaluation as ev
from spendloom.operators import fusion, quality, silver, sketches, spend, telemetry, vector_cells, vector_search
from spendloom.operators import text_index as ti
from spendloom.operators.audit import audit_statements, run_sql
from spendloom.operators.substring_match import first_matches
from spendloom.plans import questions as q
from spendloom.plans import testbed as tb
from spendloom.plans.medallion import Lake
from spendloom.schema import CATALOGUE_COLUMNS, ITEM_TEXT
from spendloom.session import new_folder
from spendloom.sources import evalset
from spendloom.sources.keyed import KeyedSink
from spendloom.sources.tables import refresh_partitions, refresh_table
from spendloom.streaming import jobs, ratings

Query = Callable[[SparkSession, str], DataFrame]

# Agencies of the test tables that are known by a short name, in the form of the alias table.
ALIASES = {"NORTH": ("customer#0000000", "customer#0000001"), "SOUTH": ("customer#0000004",)}
TERMS = (
    ("cold plate sets for field offices", "cold plate", "Plates"),
    ("blue ring replacement", "blue ring", "Rings"),
    ("submarine hull sections", "submarine", "Vessels"),
)
EMBED_WIDTH = 64
RELOADED = "1995-Q1"


def comparable(df: DataFrame) -> DataFrame:
    """Plain types for comparison: decimals as double, dates and times as text, integers as bigint."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.IntegerType):
            c = c.cast("bigint")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of floating point rounded, as their last digits depend on the order of the rows."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def _totals(report: DataFrame, *keys: str) -> DataFrame:
    return rounded(spend.totals(report, keys), avg_spend=4)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.refine(tb.bronze(spark, sf_dir)).typed


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = tb.bronze(spark, sf_dir)
    awards_raw, quarantine = silver.split_by_grain(bronze)
    # the de-duplicated rows are a written table, as in a load: three inputs of the gate derive from them
    path = new_folder(spark, "gate")
    refresh_table(silver.deduplicate(awards_raw), path)
    deduped = spark.read.parquet(path)
    typed = silver.type_and_clean(deduped)
    return quality.quality_checks(
        typed=typed,
        bronze=bronze,
        awards_raw=awards_raw,
        quarantine=quarantine,
        deduped=deduped,
        zero_amount=silver.zero_amounts(deduped),
        # the catalogue as it is searched: with the vectors that are stored for it
        catalogue=cat.unique_items(typed).join(tb.item_embeddings(spark, sf_dir).drop("label"), "item_id", "left"),
    )


def _reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table and quarter after one quarter was loaded again without any quarantined row."""
    lake, bronze = Lake(spark, new_folder(spark, "reload")), tb.bronze(spark, sf_dir)
    again = bronze.filter((F.col("quarter") == RELOADED) & F.col("contract_amount").isNotNull() & (F.col("contract_amount") != "NULL"))
    for rows, loaded in ((bronze, []), (again, [RELOADED])):
        for name, part in zip(("awards_raw", "quarantine_no_award"), silver.split_by_grain(rows)):
            lake.save(part, name, loaded)
    counted = [
        lake.read(name).groupBy("quarter").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        for name in ("awards_raw", "quarantine_no_award")
    ]
    return counted[0].unionByName(counted[1])


def _quarters_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards of quarters that have a column more than the quarters before them."""
    lake = Lake(spark, new_folder(spark, "quarters"))
    awards = tb.bronze(spark, sf_dir).select("award_ref", "region", "awardee", "quarter")
    lake.save(awards.filter(F.col("quarter") < RELOADED).drop("awardee"), "awards")
    lake.save(awards.filter(F.col("quarter") >= RELOADED), "awards")
    return lake.read("awards").select("award_ref", "region", "awardee", "quarter")


def _increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    awards = tb.awards(spark, sf_dir).select("item_id", *CATALOGUE_COLUMNS[1:], "quarter")
    first = awards.select(F.min("quarter")).scalar()
    return cat.new_items(awards, cat.unique_items(awards.filter(F.col("quarter") == first)))


def _ring_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.catalogue(spark, sf_dir).filter(contains_ci(F.col("item_name"), "ring"))


def _ring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.spend_report(tb.awards(spark, sf_dir), _ring_items(spark, sf_dir), region="a")


def _section(report: DataFrame, section: str, *keys: str) -> DataFrame:
    return report.filter(F.col("section") == section).select(
        *keys, "position", F.col("name").alias(section), "award_count", "spend"
    )


def _documents_index(spark: SparkSession, sf_dir: str) -> ti.TextIndex:
    return ti.build_index(tb.table(spark, sf_dir, "documents"), ["text"], key="doc_id")


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def _document_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        tb.table(spark, sf_dir, "documents")
        .filter(contains_ci(F.col("lang"), "E") & contains_ci(F.col("source"), "SRC1"))
        .select(F.col("doc_id").alias("item_id"))
    )


def _catalogue_index(spark: SparkSession, sf_dir: str) -> ti.TextIndex:
    return ti.build_index(tb.catalogue(spark, sf_dir), ITEM_TEXT)


def _award_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.scope_items(tb.awards(spark, sf_dir), an.scope_condition("asia", "customer#0000000"))


def _label_lists(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    queries = tb.label_queries(spark, sf_dir)
    vector = vector_search.vector_search(tb.item_embeddings(spark, sf_dir), queries, k)
    keyword = ti.keyword_search(_catalogue_index(spark, sf_dir), queries, k)
    return vector, keyword


def _ranked(df: DataFrame) -> DataFrame:
    return comparable(df.select("query_id", "item_id", "score", "rank"))


def _hybrid(spark: SparkSession, sf_dir: str) -> fusion.HybridResult:
    return fusion.hybrid_search(
        _catalogue_index(spark, sf_dir),
        tb.item_embeddings(spark, sf_dir),
        tb.label_queries(spark, sf_dir),
        tb.awards(spark, sf_dir),
        top_k=10,
        region="asia",
        agency="customer#0000000",
        catalogue=tb.catalogue(spark, sf_dir),
    )


def _discovery_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per kind of part, and one that nothing matches per region."""
    kinds = tb.table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_name").alias("name"))
    found = kinds.select(
        F.col("p_type").alias("query_id"), F.concat_ws(" ", "name", "p_type").alias("query_text")
    )
    lost = tb.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("query_id"), F.lit("nuclear submarine").alias("query_text")
    )
    return found.unionByName(lost)


def _discovery(spark: SparkSession, sf_dir: str) -> fusion.HybridResult:
    return fusion.catalogue_lookup(
        _catalogue_index(spark, sf_dir),
        _discovery_queries(spark, sf_dir),
        tb.awards(spark, sf_dir),
        agency="customer#0000001",
        region="europe",
    )


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _discovery(spark, sf_dir)
    return spend.summary_text(result.spend, result.samples, _discovery_queries(spark, sf_dir))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _discovery(spark, sf_dir)
    summaries = spend.summary_text(result.spend, result.samples, _discovery_queries(spark, sf_dir))
    return spend.context_text(summaries, ti.with_item_details(result.items, tb.catalogue(spark, sf_dir)))


def _stored_cells(spark: SparkSession, sf_dir: str, cells: int = 64) -> tuple[str, DataFrame, DataFrame]:
    """A file of all vectors by cell, and the vectors as corpus and as queries."""
    path = new_folder(spark, "cells")
    corpus = tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    vector_cells.write_cells(corpus, path, cells)
    return path, corpus, corpus.toDF("query_id", "query_vector")


def _ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every vector's ten nearest that a quarter of the cells holds."""
    path, corpus, queries = _stored_cells(spark, sf_dir)
    near = vector_cells.search_cells(spark, path, queries, k=10, probes=16)
    return vector_search.recall(near, vector_search.vector_search(corpus, queries, 10))


def _ann_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors added to a file of others; with every cell probed the search over cells is exact."""
    path = new_folder(spark, "cells")
    corpus = tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    first = corpus.filter(F.col("item_id") % 2 == 0)
    vector_cells.write_cells(first, path, 16)
    vector_cells.add_vectors(corpus, path)
    return vector_cells.search_cells(spark, path, corpus.toDF("query_id", "query_vector"), k=5, probes=16)


def _ann_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cell probed the search over cells is exact."""
    corpus, cells = tb.item_embeddings(spark, sf_dir), 16
    centroids = vector_search.train_cells(corpus, cells)
    return vector_search.approximate_search(corpus, tb.label_queries(spark, sf_dir), centroids, k=20, probes=cells)


def _name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a part as a search term over the whole catalogue."""
    terms = tb.table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))
    return first_matches(tb.catalogue(spark, sf_dir), terms, ITEM_TEXT)


def _ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.build_ground_truth(
        tb.catalogue(spark, sf_dir), tb.item_embeddings(spark, sf_dir), benchmarks=ev.BENCHMARKS + TERMS
    )


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tb.label_queries(spark, sf_dir).select(F.col("target_item_id").alias("item_id"))
    return ev.enriched_sample(
        tb.catalogue(spark, sf_dir),
        tb.item_embeddings(spark, sf_dir),
        cat.largest_award_per_item(tb.awards(spark, sf_dir)),
        done,
    )


def _retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the set, over the catalogue embedded by its own texts."""
    catalogue, make = tb.catalogue(spark, sf_dir), emb.hashing_embedder(EMBED_WIDTH)
    # the sample bounds the questions, so one task numbers them
    order = W.orderBy("target_item_id", "question")
    path = new_folder(spark, "asked")
    refresh_table(
        _ground_truth(spark, sf_dir).select(
            F.row_number().over(order).cast("bigint").alias("query_id"), F.col("question").alias("query_text"), "target_item_id"
        ),
        path,
    )
    asked = spark.read.parquet(path)
    texts = asked.select(F.col("query_id").alias("item_id"), F.col("query_text").alias("doc_text"))
    vectors = emb.embed_texts(texts, make).toDF("query_id", "query_vector")
    keyword = ti.keyword_search(ti.build_index(catalogue, ITEM_TEXT), asked, 5)
    vector = vector_search.vector_search(emb.embed(catalogue, make), vectors, 5)
    return ev.retrieval_metrics(keyword, vector, asked.select("query_id", "target_item_id"))


def _cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to every vector of the table."""
    vectors = tb.table(spark, sf_dir, "embeddings")
    corpus = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    return vector_search.vector_search(corpus, corpus.toDF("query_id", "query_vector"), 5)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.query_log(tb.table(spark, sf_dir, "events"))


def _given(events: DataFrame) -> DataFrame:
    """Ratings arrive as events of users; a user rates the query that carries the user's number."""
    return events.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").alias("log_id"),
        F.when(F.col("event_type") == "purchase", "Thumbs UP").otherwise("no").alias("feedback"),
        F.col("ts").alias("given_at"),
    )


def _unrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("feedback", F.lit(None).cast("string"))


def _distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items per year from sketches that were stored per quarter, beside the exact counts."""
    path, awards = f"{new_folder(spark, 'sketches')}/items", tb.awards(spark, sf_dir).select("item_id", "quarter")
    refresh_partitions(sketches.key_sketches(awards, "item_id", ["quarter"]), path)
    year = F.substring("quarter", 1, 4).alias("year")
    exact = awards.groupBy(year).agg(F.count_distinct("item_id").alias("exact"))
    stored_sketches = spark.read.parquet(path).select(year, "sketch")
    return sketches.checked_estimates(stored_sketches, exact, ["year"]).select("year", "exact", "within")


def _feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _given(tb.table(spark, sf_dir, "events"))
    return telemetry.with_feedback(_unrated(spark, sf_dir), given).select("id", "query", "feedback")


def _ratings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ratings as a stream of several batches, in no order of time, with a restart before the last one."""
    root, events = new_folder(spark, "ratings"), tb.table(spark, sf_dir, "events")
    for part in (F.col("event_id") % 4 > 0, F.col("event_id") % 4 == 0):
        events.filter(part).repartition(2).write.mode("append").parquet(f"{root}/events")
        given = _given(jobs.read_files(spark, f"{root}/events", events.schema, files_per_batch=1))
        # the files hold ratings of all times, so none is late
        jobs.run_to_end(ratings.stream_ratings(given, f"{root}/latest", f"{root}/checkpoint", "20000 days", 20_000))
    rated = ratings.with_ratings(_unrated(spark, sf_dir), ratings.read_ratings(spark, f"{root}/latest"))
    return rated.select("id", "query", "feedback")


def _append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a batch that holds every call twice, and a replay of it."""
    path, log = f"{new_folder(spark, 'log')}/calls", _log(spark, sf_dir)
    for batch in (log.unionByName(log), log):
        telemetry.append_log(batch, path)
    return comparable(telemetry.read_log(spark, path).select("id", "query", "latency_ms"))


def _log_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose clicks were written before feedback and tokens were logged."""
    path, log = f"{new_folder(spark, 'log')}/calls", _log(spark, sf_dir)
    old = F.col("query") == "click"
    log.filter(old).drop(*telemetry.LOG_DEFAULTS).write.parquet(path)
    telemetry.append_log(log.filter(~old), path)
    return comparable(telemetry.read_log(spark, path).select("id", "query", "feedback", "prompt_tokens", "total_tokens"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_statements(tb.logged_statements(spark, sf_dir)).drop("sql")


def _adhoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = (
        'SELECT "Region", "Awardee Size", COUNT(*) AS contracts, '
        'CAST(SUM("Contract Amount") AS DOUBLE) AS total_spend FROM gold.all_awards '
        'WHERE "Approved Budget of the Contract" > "Contract Amount" '
        'AND "Award Date" BETWEEN DATE \'1996-01-01\' AND DATE \'1999-12-31\' '
        'AND "Quantity" >= :least GROUP BY "Region", "Awardee Size"'
    )
    return run_sql(tb.awards(spark, sf_dir), statement, {"least": 10})


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(emb.embed(tb.catalogue(spark, sf_dir), emb.hashing_embedder(EMBED_WIDTH)))


def _weights(embeddings: DataFrame) -> DataFrame:
    """Non-zero entries of vectors, one per row."""
    return (
        embeddings.select("item_id", F.posexplode("embedding").alias("at", "weight"))
        .filter("weight <> 0")
        .select(
            "item_id", F.col("at").cast("bigint").alias("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight")
        )
    )


def _embed_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after a change of their width."""
    path, items = f"{new_folder(spark, 'rebuild')}/embeddings", tb.catalogue(spark, sf_dir)
    for width in (EMBED_WIDTH // 2, EMBED_WIDTH):
        emb.embed_pending(items, path, emb.hashing_embedder(width), width)
    return _weights(emb.read_embeddings(spark, path))


def _embed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors committed part by part."""
    path = f"{new_folder(spark, 'parts')}/embeddings"
    emb.embed_pending(tb.catalogue(spark, sf_dir), path, emb.hashing_embedder(EMBED_WIDTH), EMBED_WIDTH, chunk=500)
    return _weights(emb.read_embeddings(spark, path))


def _results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard as it comes back from its JSON file."""
    path, card = f"{new_folder(spark, 'results')}/scorecard", ev.answer_scorecard(tb.answer_scores(spark, sf_dir))
    evalset.write_json(card, path)
    return spark.read.schema(card.schema).json(path)


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards as they are shown: text without NULL, numbers as they are."""
    return comparable(an.display_rows(tb.awards(spark, sf_dir).select("award_ref", "awardee_size", "award_date", "contract_amount", "quantity")))


def _ground_truth_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'questions')}/set"
    evalset.write_json(_ground_truth(spark, sf_dir), path)
    return evalset.read_questions(spark, path)


BATCHES, FILE_ROWS = 4, 1_000_000


def _in_files(df: DataFrame, path: str) -> int:
    """The frame as files of at most about ``FILE_ROWS`` rows below the path; how many make a batch, for a few batches."""
    each = max(1, -(-df.count() // (BATCHES * FILE_ROWS)))
    df.repartition(BATCHES * each).write.parquet(path)
    return each


def _embed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "embed-stream")
    items = tb.catalogue(spark, sf_dir)
    refresh_table(items, f"{root}/items")
    stream = jobs.read_files(spark, f"{root}/items", items.schema, files_per_batch=4)
    make = emb.hashing_embedder(EMBED_WIDTH)
    jobs.run_to_end(
        jobs.embed_new_items(stream, f"{root}/embeddings", f"{root}/checkpoint", make, EMBED_WIDTH)
    )
    return _weights(emb.read_embeddings(spark, f"{root}/embeddings"))


def _catalogue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "catalogue-stream")
    schema = tb.table(spark, sf_dir, "lineitem").schema
    each = _in_files(tb.table(spark, sf_dir, "lineitem"), f"{root}/lines")
    stream = jobs.read_files(spark, f"{root}/lines", schema, files_per_batch=each)
    jobs.run_to_end(
        jobs.grow_catalogue(
            stream, f"{root}/items", f"{root}/checkpoint", lambda batch: tb.awards(spark, sf_dir, batch)
        )
    )
    return KeyedSink(spark, f"{root}/items", "item_id").read()


def _telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "telemetry-stream")
    schema = tb.table(spark, sf_dir, "events").schema
    # the files hold calls of all times, so none is late
    each = _in_files(tb.table(spark, sf_dir, "events"), f"{root}/events")
    log = tb.query_log(jobs.read_files(spark, f"{root}/events", schema, files_per_batch=each))
    jobs.run_to_end(jobs.stream_telemetry(log, f"{root}/windows", f"{root}/checkpoint", lateness="20000 days"))
    return comparable(jobs.read_telemetry(spark, f"{root}/windows"))


def _quarter_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tb.awards(spark, sf_dir).groupBy("quarter").agg(F.count(F.lit(1)).alias("awards"))
    return counted.select("quarter", table_prefix(F.col("quarter")).alias("prefix"), "awards")


def _period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.point_aggregate(tb.awards(spark, sf_dir), an.between_dates("1997-02-01", "1999-10-31"))


def _answer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = an.answer_totals(tb.bronze(spark, sf_dir), ["contract_amount", "approved_budget"])
    return total.select(
        F.round("total_spend", 2).alias("total_spend"), "award_count", F.round("avg_spend", 4).alias("avg_spend")
    )


def queries() -> dict[str, Query]:
    def on_awards(answer: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: comparable(answer(tb.awards(spark, sf_dir)))

    def on_log(answer: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: comparable(answer(_log(spark, sf_dir)))

    return {
        # ingestion and cleaning
        "bronze_all_string": tb.bronze,
        "grain_split_counts": lambda s, d: silver.grain_counts(tb.bronze(s, d)),
        "awards_raw": lambda s, d: silver.split_by_grain(tb.bronze(s, d))[0],
        "quarantine_no_award": lambda s, d: silver.split_by_grain(tb.bronze(s, d))[1],
        "awards_deduped": lambda s, d: silver.refine(tb.bronze(s, d)).deduped,
        "awards_typed": lambda s, d: comparable(_typed(s, d)),
        "awards_zero_amount": lambda s, d: silver.refine(tb.bronze(s, d)).zero_amount,
        "quality_gate": lambda s, d: _gate(s, d).drop("detail"),
        "quality_gate_summary": lambda s, d: quality.gate_summary(_gate(s, d)),
        "quarter_tables": _quarter_tables,
        "reload_quarter": _reload,
        "quarters_union": _quarters_union,
        # catalogue and gold
        "unique_items": lambda s, d: cat.unique_items(_typed(s, d)),
        "unique_items_increment": _increment,
        "keyless_awards": lambda s, d: cat.keyless_awards(_typed(s, d)),
        "all_awards_consolidated": lambda s, d: comparable(cat.with_item_id(_typed(s, d))),
        "largest_award_per_item": on_awards(cat.largest_award_per_item),
        # spend of items
        "spend_summary": lambda s, d: _totals(_ring_report(s, d)),
        "top_agencies": lambda s, d: _section(_ring_report(s, d), "agency"),
        "top_regions": lambda s, d: _section(_ring_report(s, d), "region"),
        "sample_awards": lambda s, d: comparable(
            spend.sample_awards(an.scoped(tb.awards(s, d), region="a"), _ring_items(s, d))
        ),
        # analytical shapes
        "profile_by_dimension": on_awards(lambda a: an.profile(a, "procurement_mode")),
        "leaderboard": on_awards(lambda a: an.leaderboard(a, "awardee")),
        "point_aggregate": on_awards(
            lambda a: an.point_aggregate(a, contains_ci(F.col("region"), "america"), F.col("quantity") > 25)
        ),
        "compare_modes": on_awards(lambda a: an.compare(a, "org_group", ["BUILDING", "MACHINERY"])),
        "budget_savings": on_awards(an.budget_savings),
        "spend_totals": on_awards(an.spend_totals),
        "spend_in_period": _period,
        "answer_totals": _answer_totals,
        "adhoc_sql": _adhoc,
        # named questions
        "q01_top_supplier": on_awards(lambda a: q.top_suppliers(a, "north", 1998, limit=1, aliases=ALIASES)),
        "q02_agency_quarter_spend": on_awards(lambda a: q.agency_spend(a, "south", "1997-Q1", ALIASES)),
        "q03_largest_in_region": on_awards(lambda a: q.largest_in_region(a, "europe")),
        "q04_compare_classifications": on_awards(lambda a: q.compare_classifications(a, "LARGE", "PROMO")),
        "q05_compare_modes": on_awards(lambda a: q.compare_modes(a, "1-URGENT", "5-LOW")),
        "q06_small_firm_contracts": on_awards(q.small_firm_contracts),
        "q07_budget_savings": on_awards(q.savings),
        "q08_supplier_contracts": on_awards(lambda a: q.supplier_contracts(a, "supplier#000000007")),
        "q09_catalogue_items": lambda s, d: comparable(
            _discovery(s, d).items.select("query_id", "item_id", "final_rank", "score", "source")
        ),
        "q09_catalogue_spend": lambda s, d: _totals(_discovery(s, d).spend, "query_id"),
        "q10_city_spend": on_awards(lambda a: q.city_spend(a, "nation_7 city")),
        "q11_agency_spend": on_awards(lambda a: q.agency_spend(a, "north", aliases=ALIASES)),
        "q12_no_match": on_awards(lambda a: an.point_aggregate(a, an.mentions("nuclear submarine"))),
        "q13_agency_profile": on_awards(lambda a: q.agency_profile(a, "south", aliases=ALIASES)),
        "q14_branch_spend": on_awards(q.branch_spend),
        "q15_largest_on_topic": on_awards(lambda a: q.largest_on_topic(a, "gear", "north", aliases=ALIASES)),
        "q16_topic_spend": on_awards(lambda a: q.topic_spend(a, "widget")),
        "q17_largest_by_organisation": on_awards(
            lambda a: q.largest_by_organisation(a, ["HOUSEHOLD"], ["LARGE", "STANDARD"])
        ),
        "q18_topic_suppliers": on_awards(lambda a: q.top_suppliers(a, "south", topic="plate", aliases=ALIASES)),
        # retrieval
        "inverted_index": lambda s, d: _documents_index(s, d).postings,
        "index_terms": lambda s, d: _documents_index(s, d).terms,
        "bm25_topk": lambda s, d: _ranked(
            ti.keyword_search(_documents_index(s, d), _benchmark_queries(s, d), 20)
        ),
        "bm25_stemmed": lambda s, d: _ranked(
            ti.keyword_search(ti.stemmed(_documents_index(s, d)), _benchmark_queries(s, d), 20, stemming=True)
        ),
        "bm25_topk_scoped": lambda s, d: _ranked(
            ti.keyword_search(_documents_index(s, d), _benchmark_queries(s, d), 20, _document_scope(s, d))
        ),
        "cosine_all": lambda s, d: _ranked(_cosine_all(s, d)),
        "cosine_topk": lambda s, d: _ranked(
            vector_search.vector_search(tb.item_embeddings(s, d), tb.label_queries(s, d), 20)
        ),
        "cosine_topk_scoped": lambda s, d: _ranked(
            vector_search.vector_search(
                tb.item_embeddings(s, d), tb.label_queries(s, d), 20, _award_scope(s, d)
            )
        ),
        "rrf_fusion": lambda s, d: comparable(
            fusion.reciprocal_rank_fusion(*_label_lists(s, d, 100), k=10).withColumn(
                "rrf_score", F.round("rrf_score", 9)
            )
        ),
        "hybrid_search": lambda s, d: comparable(
            ti.with_item_details(
                _hybrid(s, d).items.withColumn("rrf_score", F.round("rrf_score", 9)), tb.catalogue(s, d)
            )
        ),
        "hybrid_spend": lambda s, d: _totals(_hybrid(s, d).spend, "query_id"),
        "hybrid_top_agencies": lambda s, d: _section(_hybrid(s, d).spend, "agency", "query_id"),
        "hybrid_samples": lambda s, d: comparable(_hybrid(s, d).samples),
        "spend_answer_text": _summary,
        "spend_answer_context": _context,
        "ann_recall": _ann_recall,
        "ann_stored": lambda s, d: _ranked(_ann_stored(s, d)),
        "ann_all_cells": lambda s, d: _ranked(_ann_all_cells(s, d)),
        # evaluation
        "ground_truth_queries": _ground_truth,
        "name_matches": _name_matches,
        "enriched_sample": _enriched,
        "retrieval_metrics": _retrieval_metrics,
        "ground_truth_json": _ground_truth_json,
        "results_json": _results_json,
        "display_rows": _display,
        "answer_scorecard": lambda s, d: ev.answer_scorecard(tb.answer_scores(s, d)),
        # embedding jobs
        "pending_embeddings": lambda s, d: emb.pending_items(tb.catalogue(s, d), tb.item_embeddings(s, d)).select(
            "item_id"
        ),
        "next_chunk": lambda s, d: emb.next_chunk(
            emb.pending_items(tb.catalogue(s, d), tb.item_embeddings(s, d))
        ).select("item_id"),
        "embed_rebuild": _embed_rebuild,
        "embed_parts": _embed_parts,
        "doc_text": lambda s, d: emb.payloads(cat.unique_items(_typed(s, d))),
        "embedding_cost": lambda s, d: comparable(
            emb.chunk_log(emb.pending_items(tb.catalogue(s, d), tb.item_embeddings(s, d)))
        ),
        "item_embeddings": _embedded,
        # telemetry
        "telemetry_kpis": on_log(
            lambda log: rounded(telemetry.key_figures(log), avg_latency_ms=4, total_cost_usd=6, satisfaction_rate=4)
        ),
        "telemetry_feedback": on_log(telemetry.feedback_split),
        "telemetry_feedback_latest": _feedback_latest,
        "telemetry_recent": on_log(telemetry.recent_queries),
        "telemetry_latest": on_log(telemetry.latest_queries),
        "telemetry_latency": on_log(telemetry.latency_series),
        "telemetry_cost": on_log(lambda log: telemetry.cost_by(log, "query")),
        "append_log": _append_log,
        "distinct_sketches": _distinct_sketches,
        "log_evolution": _log_evolution,
        "query_audit": _audit,
        # streams
        "embed_stream": _embed_stream,
        "catalog_stream": _catalogue_stream,
        "telemetry_stream": _telemetry_stream,
        "ratings_stream": _ratings_stream,
    }
