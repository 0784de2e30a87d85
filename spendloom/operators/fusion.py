"""Reciprocal rank fusion and hybrid search with spend."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.functions.text import STOP_WORDS
from spendloom.operators.analytics import scope_condition
from spendloom.operators.spend import spend_by_query
from spendloom.operators.text_index import TextIndex, keyword_search, scope_items
from spendloom.operators.vector_search import vector_search
from spendloom.session import stored

RRF_K = 60
# The candidate pool that spend is summed over: ten times the shown results, at least this many per list.
POOL_MIN = 200


class HybridResult(NamedTuple):
    items: DataFrame
    pool: DataFrame
    spend: DataFrame
    samples: DataFrame


def reciprocal_rank_fusion(
    vector: DataFrame, keyword: DataFrame, k: int = 10, k_constant: int = RRF_K
) -> DataFrame:
    """Fuse two ranked lists per query.

    Equal scores keep the vector order first, then keyword-only items in keyword order. Score and source are
    those of the vector list where it has the item. A query with results in one list only keeps that list's
    order, and its ``rrf_score`` is NULL.
    """
    v = vector.select(
        "query_id", "item_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score")
    )
    w = keyword.select(
        "query_id", "item_id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score")
    )

    def share(rank: str):
        return F.coalesce(F.lit(1.0) / (F.lit(k_constant) + F.col(rank)), F.lit(0.0))

    both = v.join(w, ["query_id", "item_id"], "full_outer").withColumn(
        "rrf_score", share("vector_rank") + share("keyword_rank")
    )
    per_query = W.partitionBy("query_id")
    order = per_query.orderBy(
        F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")
    )
    fused_here = (F.count("vector_rank").over(per_query) > 0) & (F.count("keyword_rank").over(per_query) > 0)
    return (
        both.withColumn("fused", fused_here)
        .withColumn("final_rank", F.row_number().over(order))
        .filter(F.col("final_rank") <= k)
        .select(
            "query_id",
            "item_id",
            "final_rank",
            F.when(F.col("fused"), F.col("rrf_score")).alias("rrf_score"),
            F.coalesce("vector_score", "keyword_score").alias("score"),
            F.when(F.col("vector_rank").isNotNull(), "vector").otherwise("keyword").alias("source"),
        )
    )


def candidate_pool(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """The (query_id, item_id) of either list; a list names an item once, so the outer join is the set union."""
    pairs = ["query_id", "item_id"]
    return vector.select(*pairs).join(keyword.select(*pairs), pairs, "full_outer")


def hybrid_search(
    index: TextIndex,
    corpus: DataFrame | None,
    queries: DataFrame,
    awards: DataFrame,
    top_k: int = 10,
    region: str | None = None,
    agency: str | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    catalogue: DataFrame | None = None,
) -> HybridResult:
    """Keyword and vector retrieval for a batch of queries, fused, with spend over the whole pool.

    With a ``catalogue`` vectors are joined with it before the cut, so a vector without an item takes no rank.

    ``queries`` has (query_id, query_text) and, when vectors are searched too, query_vector. Without a
    ``corpus`` or vectors the keyword list stands alone. A query without any candidate gets the spend of the
    whole filter when there is a filter, and zeros when there is none.
    """
    limit = max(10 * top_k, POOL_MIN)
    condition = scope_condition(region, agency)
    scope = None if condition is None else stored(scope_items(awards, condition), "scope")
    asked = queries.filter(F.trim("query_text") != "")
    # at most ``limit`` rows per query, read by the fusion, the pool and the spend
    keyword = stored(keyword_search(index, asked, limit, scope, stop_words), "keyword-list")
    if corpus is not None and "query_vector" in queries.columns:
        if catalogue is not None:
            corpus = corpus.join(catalogue.select("item_id"), "item_id", "left_semi")
        vector = stored(vector_search(corpus, asked, limit, scope), "vector-list")
    else:
        vector = keyword.filter(F.lit(False))
    items = reciprocal_rank_fusion(vector, keyword, top_k)
    pool = candidate_pool(vector, keyword)
    spend, samples = spend_by_query(
        awards, queries.select("query_id"), pool, items.select("query_id", "item_id"), region, agency
    )
    return HybridResult(items, pool, spend, samples)


def catalogue_lookup(
    index: TextIndex,
    queries: DataFrame,
    awards: DataFrame,
    agency: str | None = None,
    region: str | None = None,
) -> HybridResult:
    """The catalogue discovery preset: five results, keyword retrieval only."""
    return hybrid_search(index, None, queries.select("query_id", "query_text"), awards, 5, region, agency)
