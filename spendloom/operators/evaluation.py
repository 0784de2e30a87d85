"""Evaluation sets and scores: sampled questions, retrieval metrics, answer scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.text import blank_if_missing
from spendloom.operators.fusion import reciprocal_rank_fusion
from spendloom.operators.substring_match import first_matches

# Fixed values: (question, search term, category) of the hand-written benchmark questions.
BENCHMARKS = (
    ("Bond Paper A4 70gsm office supplies", "Bond Paper", "Office Supplies"),
    ("Catering services meals and snacks for seminar training", "Catering Services", "Food & Catering"),
    ("Desktop computer Core i7 workstation", "Desktop Computer", "Information Technology"),
    ("Medical supplies disposable surgical gloves syringes", "Surgical Gloves", "Medical & Healthcare"),
    ("Heavy equipment asphalt road repair dump truck", "Dump Truck", "Vehicles & Heavy Equipment"),
    ("Security services licensed security guard outpost", "Security Services", "Security & Defense"),
    ("Janitorial cleaning supplies floor wax bleach disinfectant", "Janitorial", "Cleaning & Maintenance"),
    ("Diesel fuel gasoline procurement for government vehicles", "Fuel", "Fuel & Lubricants"),
    ("Air conditioning unit inverter split type installation", "Air Conditioning", "Appliances & HVAC"),
    ("Construction materials cement gravel sand rebar", "Cement", "Civil Works & Construction"),
)
# Mean score that each dimension of an answer scorecard has to reach.
ANSWER_TARGETS = {"faithfulness": 4.5, "relevance": 4.5, "completeness": 4.0, "overall": 4.5}
QUESTIONS_PER_ITEM = 2


def stable_sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n random rows that are the same on every run: the smallest md5 hashes of key and seed."""
    lot = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return df.orderBy(lot, F.col(key)).limit(n)


def random_sample(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def item_questions() -> Column:
    """Up to two question texts for a catalogue item, from its own fields."""
    name = blank_if_missing(F.col("item_name"))
    title = blank_if_missing(F.col("notice_title"))
    desc = blank_if_missing(F.col("item_desc"))
    kind = blank_if_missing(F.col("unspsc_desc"))

    def words(c: Column) -> Column:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    choices = F.array(
        F.when(name != "", F.concat(F.lit("Procurement of "), name)),
        F.when(
            (name != "") & (kind != "") & ~F.contains(F.lower(name), F.lower(kind)),
            F.concat(name, F.lit(" "), kind),
        ),
        F.when(
            (title != "") & (F.lower(title) != F.lower(name)) & (F.size(words(title)) > 3),
            F.array_join(F.slice(words(title), 1, 6), " "),
        ),
        F.when(
            (desc != "") & (F.size(words(desc)) > 3),
            F.trim(F.concat(name, F.lit(" "), F.substring(desc, 1, 40))),
        ),
    )
    return F.slice(F.filter(choices, lambda q: q.isNotNull()), 1, QUESTIONS_PER_ITEM)


def templated_questions(catalogue: DataFrame, embedded: DataFrame, sample_size: int = 300) -> DataFrame:
    """Questions made from a sample of named items that have a vector."""
    usable = catalogue.filter(F.col("item_name").isNotNull() & (F.col("item_name") != "NULL"))
    with_vector = usable.join(embedded.select("item_id"), "item_id", "left_semi")
    return stable_sample(with_vector, "item_id", sample_size).select(
        F.explode(item_questions()).alias("question"),
        F.col("item_id").alias("target_item_id"),
        F.col("item_name").alias("target_item_name"),
        F.coalesce(F.nullif(F.col("unspsc_desc"), F.lit("")), F.lit("Uncategorized")).alias("category"),
        F.lit("templated").alias("source"),
    )


def benchmark_questions(
    catalogue: DataFrame, benchmarks: Sequence[tuple[str, str, str]] | DataFrame = BENCHMARKS
) -> DataFrame:
    """Hand-written questions, each with the first item whose name or title contains its search term.

    ``benchmarks`` has (question, term, category) of any number of questions.
    """
    if not isinstance(benchmarks, DataFrame):
        benchmarks = catalogue.sparkSession.createDataFrame(list(benchmarks), "question string, term string, category string")
    found = first_matches(catalogue, benchmarks, ("item_name", "notice_title"))
    # The first of the items wins where a question has several terms.
    asked = benchmarks.select("question", "category", F.lower("term").alias("term")).join(found, "term")
    best = asked.groupBy("question", "category").agg(F.min("item_id").alias("item_id"))
    return best.join(catalogue.select("item_id", "item_name"), "item_id").select(
        "question", F.col("item_id").alias("target_item_id"), F.col("item_name").alias("target_item_name"), "category",
        F.lit("hand-written").alias("source"),
    )


def build_ground_truth(
    catalogue: DataFrame,
    embedded: DataFrame,
    sample_size: int = 300,
    benchmarks: Sequence[tuple[str, str, str]] | DataFrame = BENCHMARKS,
) -> DataFrame:
    """Templated plus hand-written questions."""
    return templated_questions(catalogue, embedded, sample_size).unionByName(
        benchmark_questions(catalogue, benchmarks)
    )


def enriched_sample(
    catalogue: DataFrame,
    embedded: DataFrame,
    largest_awards: DataFrame,
    done: DataFrame,
    sample_size: int = 50,
    oversample: int = 3,
) -> DataFrame:
    """Sampled items with their largest award, for writing questions about, until ``sample_size`` are done.

    What is missing is drawn ``oversample`` times over; done items and short names are left out of the draw.
    """
    missing = max(0, sample_size - done.select("item_id").distinct().limit(sample_size).count())
    named = catalogue.filter((F.length("item_name") > 3) & (F.col("item_name") != "NULL"))
    joined = (
        named.join(embedded.select("item_id"), "item_id", "left_semi")
        .join(largest_awards.drop("award_ref"), "item_id")
        .select(
            "item_id",
            *[blank_if_missing(F.col(c)).alias(c) for c in ("notice_title", "item_name", "item_desc")],
            F.coalesce(F.nullif(blank_if_missing(F.col("unspsc_desc")), F.lit("")), F.lit("General")).alias(
                "category"
            ),
            *[blank_if_missing(F.col(c)).alias(c) for c in ("agency", "region", "awardee")],
            F.coalesce(F.col("contract_amount").cast("double"), F.lit(0.0)).alias("amount"),
        )
    )
    drawn = stable_sample(joined, "item_id", missing * oversample)
    long_enough = (F.length("item_name") >= 4) | (F.length("notice_title") >= 4)
    left = drawn.join(done.select("item_id"), "item_id", "left_anti").filter(long_enough)
    return stable_sample(left, "item_id", missing)


def retrieval_metrics(keyword: DataFrame, vector: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """Hit rate and mean reciprocal rank at k for keyword, vector and fused retrieval.

    ``targets`` has (query_id, target_item_id), one row per question; a question whose target is missing
    from a list counts as zero. The fused list is made from the two lists cut at k.
    """
    wanted = targets.select("query_id", F.col("target_item_id").alias("item_id"))
    kw = keyword.filter(F.col("rank") <= k)
    vec = vector.filter(F.col("rank") <= k)
    fused = reciprocal_rank_fusion(vec, kw, k)
    placed = wanted
    for strategy, ranked, rank in (("keyword", kw, "rank"), ("vector", vec, "rank"), ("hybrid", fused, "final_rank")):
        at = ranked.select("query_id", "item_id", F.col(rank).alias(strategy))
        placed = placed.join(at, ["query_id", "item_id"], "left")
    strategies = ("keyword", "vector", "hybrid")
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("rank")) for s in strategies])
    return (
        placed.select(F.inline(each))
        .groupBy("strategy")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("hit_rate"),
            F.round(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mrr"),
        )
    )


def mean_latency(timings: DataFrame) -> DataFrame:
    """Mean latency per strategy from (strategy, query_id, latency_ms); fused runs cost the sum of both."""
    return timings.groupBy("strategy").agg(F.avg("latency_ms").alias("avg_latency_ms"))


def score_answers(scores: DataFrame) -> DataFrame:
    """Scores with their mean per answer."""
    overall = (F.col("faithfulness") + F.col("relevance") + F.col("completeness")) / F.lit(3.0)
    return scores.withColumn("overall", overall)


def answer_scorecard(scores: DataFrame) -> DataFrame:
    """Mean per dimension, two decimals, against its target."""
    means = score_answers(scores).agg(
        F.count(F.lit(1)).alias("questions"),
        *[F.round(F.avg(name), 2).alias(name) for name in ANSWER_TARGETS],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"),
                F.col("questions"),
                F.col(name).alias("mean_score"),
                F.lit(target).alias("target"),
                (F.col(name) >= target).alias("passed"),
            )
            for name, target in ANSWER_TARGETS.items()
        ]
    )
    return means.select(F.inline(rows))
