"""BM25 over an inverted index, for batches of queries.

Index tables: ``postings(term, item_id, tf, doc_len)``, ``terms(term, df)``, a one-row ``stats``, and the postings once
more in blocks that carry their largest contribution (``block_postings``), which searches read. The document length
travels with the posting, so scoring needs no join per document.

Items lie in buckets of about ``BUCKET_TOKENS`` tokens, not by term, so the postings of a very common term are spread
over all tasks. A task scores the items of its bucket exactly and returns the k best per query. An index that isn't
stored makes the blocks of the asked terms on the way.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.functions.stemming import stems
from spendloom.functions.text import STOP_WORDS, clean_query, search_tokens
from spendloom.operators import block_postings
from spendloom.session import stored

# Usual BM25 constants (Robertson & Zaragoza 2009).
K1 = 1.2
B = 0.75
SCORE_DIGITS = block_postings.SCORE_DIGITS
BUCKET_TOKENS = 300_000  # of indexed text in a bucket


class TextIndex(NamedTuple):
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None
    buckets: int | None = None


def build_index(
    items: DataFrame,
    columns: Sequence[str],
    key: str = "item_id",
    stop_words: Sequence[str] = STOP_WORDS,
    partitions: int | None = None,
) -> TextIndex:
    """Index the text columns of the items, whole texts, lazily.

    ``partitions`` is the least number of buckets; more follow from the length of the texts.
    """
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    parts = partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Items are dealt by a hash column of their own: Spark drops a repartition by a column that happens to cluster the
    # input already, and then packs a small input into one task.
    dealt = items.select(F.col(key).alias("item_id"), F.xxhash64(key).alias("_hash"), text.alias("text")).repartition(parts, "_hash")
    docs = dealt.select("item_id", "_hash", search_tokens(F.col("text"), stop_words).alias("tokens")).select(
        "item_id", "_hash", "tokens", F.size("tokens").cast("bigint").alias("doc_len")
    )
    postings = (
        _exploded(docs, "item_id", "_hash", "doc_len", tokens=F.col("tokens"))
        .groupBy("term", "item_id", "_hash", "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select("term", "item_id", "tf", "doc_len")
    )
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tokens = F.coalesce(F.sum("doc_len"), F.lit(0))
    stats = docs.agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.sum("doc_len") / F.count_if(F.col("doc_len") > 0)).alias("avg_len"),
        F.greatest(F.lit(parts), F.ceil(tokens / BUCKET_TOKENS)).cast("int").alias("buckets"),
    )
    return TextIndex(postings, terms, stats)


def stemmed(index: TextIndex) -> TextIndex:
    """The index over word stems. Its postings are written below the shared folder: weights and searches read them, and
    the texts are read and their words stemmed once."""
    by_stem = index.postings.withColumn("term", stems(F.col("term")))
    postings = by_stem.groupBy("term", "item_id", "doc_len").agg(F.sum("tf").alias("tf")).select(*index.postings.columns)
    postings = stored(postings, "stemmed-postings")
    return TextIndex(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), index.stats)


def _with_blocks(index: TextIndex, postings: DataFrame | None = None) -> DataFrame:
    """The blocks of the index, or of some of its postings."""
    # One subquery, which every use of a number shares.
    stats = index.stats.select(F.struct("n_items", "avg_len", "buckets")).scalar()
    idf = F.log((stats["n_items"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    length = 1.0 - B + B * F.col("doc_len") / stats["avg_len"]
    part = F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * length)
    return block_postings.block_postings(
        index.postings if postings is None else postings, index.terms, part, stats["buckets"], idf
    )


def write_index(index: TextIndex, path: str) -> None:
    """Rebuild the stored index: postings, terms and stats once, then the blocks from them.

    Blocks are partitioned by a hash of the term and, inside a partition, ranged by term and bucket over files.
    """
    spark = index.postings.sparkSession
    for name in ("postings", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    postings, stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "stats"))
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    stored = TextIndex(postings, spark.read.parquet(f"{path}/terms"), stats)
    blocks = _with_blocks(stored)
    files = max(1, stats.first()["buckets"])
    blocks.repartitionByRange(files, "part", "term", "bucket").sortWithinPartitions("part", "term", "bucket").write.mode(
        "overwrite"
    ).partitionBy("part").parquet(f"{path}/blocks")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    postings, terms, stats, blocks = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats", "blocks"))
    return TextIndex(postings, terms, stats, blocks, stats.first()["buckets"])


def query_terms(queries: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, terms) of the cleaned query texts, each term once."""
    return queries.select(
        "query_id", F.array_distinct(search_tokens(clean_query(F.col("query_text")), stop_words)).alias("terms")
    )


def _exploded(df: DataFrame, *keep: str, tokens: Column) -> DataFrame:
    """One row per token. The outer form keeps Spark from testing the array for emptiness below the shuffle,
    which would tokenise every text once more."""
    return df.select(*keep, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())


def keyword_search(
    index: TextIndex,
    queries: DataFrame,
    k: int = 20,
    scope: DataFrame | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    stemming: bool = False,
) -> DataFrame:
    """Top k items per query by BM25: (query_id, item_id, score, rank, source).

    ``stemming`` belongs to an index made by ``stemmed``: the words of the queries become stems too.

    ``queries`` has (query_id, query_text). Items that match no term are absent. ``scope`` holds the allowed
    item ids; it applies before the ranking, so k items come from inside the scope.
    """
    wanted = query_terms(queries, stop_words)
    if stemming:
        words = _exploded(wanted, "query_id", tokens=F.col("terms"))
        wanted = words.groupBy("query_id").agg(F.collect_set(stems(F.col("term"))).alias("terms"))
    blocks = index.blocks
    if blocks is None:
        # Only postings of asked terms get on; Catalyst moves the semi join below their aggregate.
        blocks = _with_blocks(index, index.postings.join(_exploded(wanted, tokens=F.col("terms")).distinct(), "term", "left_semi"))
    if index.buckets is not None:
        buckets = F.lit(index.buckets)
    else:
        buckets = index.stats.select(F.struct("n_items", "avg_len", "buckets")).scalar()["buckets"]
    return rank_results(block_postings.search(blocks, buckets, wanted, k, scope), k, "keyword")


def rank_results(scores: DataFrame, k: int, source: str) -> DataFrame:
    """Keep the k best per query, rank from 1, ties by item id. The cut also happens before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("source", F.lit(source))
    )


def scope_items(awards: DataFrame, condition: Column) -> DataFrame:
    """Distinct ids of the items that have an award inside the condition."""
    return awards.filter(condition & F.col("item_id").isNotNull()).select("item_id").distinct()


def with_item_details(ranked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Ranked rows with the texts and codes of their items."""
    return ranked.join(catalogue, "item_id")
