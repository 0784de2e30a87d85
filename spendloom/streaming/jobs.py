"""Incremental jobs: catalogue growth, embedding of new items, telemetry figures.

Every sink write is safe to replay. The catalogue and the embeddings are keyed sinks (``sources.keyed``), whose Bloom
filters tell which stored rows a batch has to be held against; a telemetry batch overwrites its own folder. State and progress live in the checkpoint folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spendloom.functions.values import normal_feedback
from spendloom.operators.catalogue import unique_items
from spendloom.operators.embedding import DIMENSIONS, Embedder, embed, wrong_width
from spendloom.session import stored
from spendloom.sources.keyed import KeyedSink
from spendloom.sources.tables import _folder

# Calls of a day may arrive up to a week after the newest one.
LATENESS = "7 days"


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """New Parquet files below a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def grow_catalogue(
    awards: DataFrame,
    catalogue_path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the new items of each batch of awards. ``prepare`` turns a batch into awards first.

    What was stored is read with ``KeyedSink.read``.
    """
    sink = KeyedSink(awards.sparkSession, catalogue_path, "item_id")

    def merge(batch: DataFrame, _: int) -> None:
        sink.append(unique_items(prepare(batch) if prepare else batch))

    return _start(awards.writeStream.foreachBatch(merge), checkpoint)


def embed_new_items(
    items: DataFrame,
    embeddings_path: str,
    checkpoint: str,
    make_embedder: Callable[[], Embedder],
    dimensions: int = DIMENSIONS,
) -> StreamingQuery:
    """Embed the items of each batch that have no stored vector yet.

    A stream sees new items only, so it can't rebuild a table of vectors of another width: it refuses, before it
    writes, and ``embed_pending`` rebuilds. Each append has vectors of one width, so one stored row tells it.
    """
    sink = KeyedSink(items.sparkSession, embeddings_path, "item_id")

    def merge(batch: DataFrame, _: int) -> None:
        held = sink.read()
        if held is not None and not wrong_width(held.limit(1), dimensions).isEmpty():
            raise ValueError(f"stored vectors are not {dimensions} wide; rebuild them with embed_pending")
        sink.append_missing(embed(sink.missing(batch), make_embedder))

    return _start(items.writeStream.foreachBatch(merge), checkpoint)


def telemetry_windows(log: DataFrame, width: str = "1 day", lateness: str | None = None) -> DataFrame:
    """Calls, latency and feedback per time window. With ``lateness`` old windows leave the state."""
    # watermarks need a time with a zone
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    timed = timed.withWatermark("timestamp", lateness) if lateness else timed
    verdict = normal_feedback(F.col("feedback"))
    return (
        timed.groupBy(F.window("timestamp", width))
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.sum(F.col("latency_ms").cast("decimal(18,4)")).alias("latency_sum"),
            F.count_if(verdict == "thumbs_up").alias("thumbs_up"),
            F.count_if(verdict == "thumbs_down").alias("thumbs_down"),
        )
        .select(F.col("window.start").alias("window_start"), "queries", "latency_sum", "thumbs_up", "thumbs_down")
    )


def stream_telemetry(
    log: DataFrame, path: str, checkpoint: str, width: str = "1 day", lateness: str | None = LATENESS, compact_after: int = 16
) -> StreamingQuery:
    """Write the windows each batch touched; a rerun of a batch replaces its own folder.

    After every ``compact_after`` batches the folders so far become one with a row per window.

    Epochs belong to a checkpoint, which counts them from 0, so each checkpoint writes below a folder of its own.
    Windows that end ``lateness`` before the newest call leave the state; later calls for them are dropped.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def save(batch: DataFrame, epoch: int) -> None:
        stamped = batch.withColumn("written_at", F.current_timestamp())
        stamped.write.mode("overwrite").parquet(f"{path}/run={run}/epoch={epoch}")
        if epoch % compact_after == compact_after - 1:
            compact_epochs(batch.sparkSession, f"{path}/run={run}", epoch, _last_written)

    windows = telemetry_windows(log, width, lateness)
    return _start(windows.writeStream.outputMode("update").foreachBatch(save), checkpoint)


def compact_epochs(spark: SparkSession, path: str, last: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Put one merged folder in the place of the epochs up to ``last``; of a replay the same rows come out.

    The merged rows are written aside and then as epoch ``last``, before older epochs go; ``merge`` must give the same
    for rows that it sees twice, which is what a reader meets in between.
    """
    store, folder = _folder(spark, path)
    old = []
    for status in store.listStatus(folder):
        name, _, number = status.getPath().getName().partition("=")
        if name == "epoch" and number.isdigit() and int(number) < last:
            old.append(status.getPath())
    merged = stored(merge(spark.read.option("basePath", path).parquet(path).filter(F.col("epoch") <= last)), "compacted")
    merged.write.mode("overwrite").parquet(f"{path}/epoch={last}")
    for epoch in old:
        store.delete(epoch, True)


def _last_written(figures: DataFrame) -> DataFrame:
    columns = [c for c in figures.columns if c not in ("window_start", "epoch")]
    latest = figures.groupBy("window_start").agg(F.max_by(F.struct(*columns), F.struct("written_at", "epoch")).alias("v"))
    return latest.select("window_start", "v.*")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The figures of every window as they were last written."""
    columns = ("queries", "latency_sum", "thumbs_up", "thumbs_down")
    latest = (
        spark.read.option("basePath", path)
        .parquet(path)
        .groupBy("window_start")
        .agg(F.max_by(F.struct(*columns), F.struct("written_at", "epoch")).alias("v"))
    )
    return latest.select(
        "window_start",
        "v.queries",
        F.round((F.col("v.latency_sum") / F.col("v.queries")).cast("double"), 4).alias("avg_latency_ms"),
        "v.thumbs_up",
        "v.thumbs_down",
    )


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(query: StreamingQuery) -> None:
    """Wait until everything available was processed; a failed stream raises here."""
    query.awaitTermination()
