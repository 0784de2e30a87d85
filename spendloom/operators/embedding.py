"""Embedding jobs: pending items, payload, pluggable embedder, width guard, per-chunk cost log."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.functions.text import item_payload
from spendloom.functions.values import PHP_PER_USD, embed_cost, token_estimate
from spendloom.schema import ITEM_TEXT
from spendloom.session import new_folder, stored
from spendloom.sources.keyed import KeyedSink
from spendloom.sources.tables import refresh_table

DIMENSIONS = 768
REQUEST_SIZE = 100
CHUNK_SIZE = 500
# Words whose bucket a task remembers.
KNOWN_WORDS = 100_000
EMBEDDING_SCHEMA = "item_id string, embedding array<float>"

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[], Embedder]:
    """A deterministic embedder without a model: word counts hashed into buckets, unit length."""

    def make() -> Embedder:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            if word not in buckets:
                if len(buckets) == KNOWN_WORDS:
                    buckets.clear()
                buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimensions
            return buckets[word]

        def embed(texts: list[str]) -> list[list[float]]:
            vectors = []
            for text in texts:
                counts = Counter(bucket(word) for word in re.findall("[a-z0-9]+", text.lower()))
                length = math.sqrt(sum(n * n for n in counts.values())) or 1.0
                vector = [0.0] * dimensions
                for at, n in counts.items():
                    vector[at] = n / length
                vectors.append(vector)
            return vectors

        return embed

    return make


def payloads(items: DataFrame) -> DataFrame:
    """(item_id, doc_text): the text that is embedded."""
    return items.select("item_id", item_payload(*[F.col(c) for c in ITEM_TEXT]).alias("doc_text"))


def pending_items(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Items without a stored vector."""
    return items.join(embeddings.select("item_id"), "item_id", "left_anti")


def next_chunk(pending: DataFrame, limit: int = CHUNK_SIZE) -> DataFrame:
    """The first pending items in id order."""
    return pending.orderBy("item_id").limit(limit)


def embed(items: DataFrame, make_embedder: Callable[[], Embedder]) -> DataFrame:
    """(item_id, embedding) of catalogue items."""
    return embed_texts(payloads(items), make_embedder)


def embed_texts(texts: DataFrame, make_embedder: Callable[[], Embedder]) -> DataFrame:
    """(item_id, embedding) of ``texts(item_id, doc_text)``. The embedder is built once per task and called with batches of requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for batch in batches:
            for at in range(0, len(batch), REQUEST_SIZE):
                part = batch.iloc[at : at + REQUEST_SIZE]
                vectors = model(list(part["doc_text"]))
                yield pd.DataFrame({"item_id": part["item_id"].to_numpy(), "embedding": vectors})

    kind = texts.schema["item_id"].dataType.simpleString()
    return texts.select("item_id", "doc_text").mapInPandas(run, f"item_id {kind}, embedding array<float>")


def wrong_width(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Stored vectors of another width."""
    return embeddings.filter(F.size("embedding") != dimensions)


def embed_pending(
    items: DataFrame,
    path: str,
    make_embedder: Callable[[], Embedder],
    dimensions: int = DIMENSIONS,
    limit: int | None = None,
    chunk: int | None = None,
) -> None:
    """Embed what is missing and append it; vectors of another width are rebuilt from scratch.

    The table is a keyed sink. With ``chunk``, the pending items are dealt once into parts of about so many, by the hash
    of their id, and committed part by part, each by its own task; what a part wrote stays if a later one fails, and the
    next run embeds only the rest. Without it all are committed together.
    """
    sink = KeyedSink(items.sparkSession, path, "item_id")
    held = sink.read()
    if held is not None and not wrong_width(held, dimensions).isEmpty():
        sink.clear()
    todo = sink.missing(items)
    if limit:
        todo = stored(next_chunk(todo, limit), "next-items")
    if chunk:
        sink.append_parts(todo, chunk, lambda part: embed(part, make_embedder))
    else:
        sink.append_missing(embed(todo, make_embedder))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors (item_id, embedding); none before the first run."""
    held = KeyedSink(spark, path, "item_id").read()
    return spark.createDataFrame([], EMBEDDING_SCHEMA) if held is None else held


def numbered(items: DataFrame) -> DataFrame:
    """Items with their position in id order, without one global sort.

    The items are written in ranges of the id with the number of their range, so that it stays the same for both
    uses; a count per range, a running sum over the counts (one row per task of the write), and a position inside
    each range.
    """
    path = new_folder(items.sparkSession, "ranged")
    refresh_table(items.repartitionByRange("item_id").withColumn("_range", F.spark_partition_id()), path)
    ranged = items.sparkSession.read.parquet(path)
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    starts = (
        ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_start"))
    )
    inside = F.row_number().over(W.partitionBy("_range").orderBy("item_id"))
    return (
        ranged.withColumn("_at", inside)
        .join(starts, "_range")
        .withColumn("position", F.col("_start") + F.col("_at"))
        .drop("_range", "_at", "_start")
    )


def running_total(df: DataFrame, order: str, columns: dict[str, str], block: int = 1000) -> DataFrame:
    """Running sums along a dense integer order, in two levels: inside blocks, then over block totals."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = blocked.groupBy("_block").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_block", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in columns]
    )
    inside = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals: dict[str, Column] = {
        name: F.sum(c).over(inside) + F.col(f"_off_{c}") for c, name in columns.items()
    }
    joined = blocked.join(offsets, "_block").withColumns(totals)
    return joined.drop("_block", *[f"_off_{c}" for c in columns])


def chunk_log(items: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Items, tokens and cost per chunk of items in id order, with running totals."""
    chunked = numbered(payloads(items)).withColumn(
        "chunk", F.floor((F.col("position") - 1) / chunk_size) + 1
    )
    chunks = chunked.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("items"),
        token_estimate(F.sum(F.length("doc_text"))).alias("tokens"),
    )
    log = running_total(chunks, "chunk", {"items": "total_items", "tokens": "total_tokens"})
    total_cost = embed_cost(F.col("total_tokens"))
    return log.select(
        "chunk",
        "items",
        "tokens",
        F.round(embed_cost(F.col("tokens")), 10).alias("cost_usd"),
        "total_items",
        "total_tokens",
        F.round(total_cost, 10).alias("total_cost_usd"),
        F.round(total_cost * PHP_PER_USD, 8).alias("total_cost_php"),
    )


def with_rate(log: DataFrame, started: str = "started_at", finished: str = "finished_at") -> DataFrame:
    """Items per second of each chunk, from its timestamps."""
    seconds = F.col(finished).cast("double") - F.col(started).cast("double")
    return log.withColumn("items_per_second", F.when(seconds > 0, F.col("items") / seconds).otherwise(0.0))
