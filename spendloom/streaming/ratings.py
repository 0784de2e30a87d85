"""Ratings of logged queries as keyed state of a stream.

The state of a log id is its latest rating. Ratings may come in any order and more than once: of two the later one
wins, of equal times the greater verdict, as in the batch join ``telemetry.with_feedback``. Only a change of the latest
rating is written. A rating that is ``lateness`` older than the newest one seen is dropped, and an id's state leaves
``kept`` after its own latest rating, so the state holds the ids that are still being rated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spendloom.functions.values import normal_feedback
from spendloom.sources.tables import read_or_empty
from spendloom.streaming.jobs import _start, compact_epochs

LATENESS = "7 days"
KEPT_DAYS = 30
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LATEST = "log_id bigint, verdict string, given_at timestamp"


class LatestRating(StatefulProcessor):
    """Keeps the latest rating of a log id and emits it whenever it changes."""

    def __init__(self, kept_days: int) -> None:
        self.kept_ms = kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "given_ms bigint, verdict string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # The batch's own latest rating first; a hot id holds one rating at a time.
        best = max((r["given_ms"], r["verdict"]) for r in rows)
        held = self.latest.get()
        if held is not None and best <= (held[0], held[1]):
            return
        self.latest.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] + self.kept_ms)
        yield Row(log_id=key[0], verdict=best[1], given_ms=best[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_ratings(ratings: DataFrame, lateness: str = LATENESS, kept_days: int = KEPT_DAYS) -> DataFrame:
    """Changes of the latest rating per log id, of the stream ``ratings(log_id, feedback, given_at)``.

    Null ids, times and ratings are left out.
    """
    timed = ratings.select(
        F.col("log_id").cast("bigint").alias("log_id"),
        normal_feedback(F.col("feedback")).alias("verdict"),
        F.col("given_at").cast("timestamp").alias("given_at"),
    ).dropna()
    keyed = timed.withWatermark("given_at", lateness).withColumn("given_ms", F.unix_millis("given_at"))
    changes = keyed.groupBy("log_id").transformWithState(
        LatestRating(kept_days), "log_id bigint, verdict string, given_ms bigint", "Update", "EventTime"
    )
    return changes.select("log_id", "verdict", F.timestamp_millis("given_ms").alias("given_at"))


def stream_ratings(
    ratings: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS, kept_days: int = KEPT_DAYS, compact_after: int = 16
) -> StreamingQuery:
    """Write what each batch of ratings changes; a rerun of a batch replaces its own folder.

    After every ``compact_after`` batches the folders so far become one with a row per log id.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/epoch={epoch}")
        if epoch % compact_after == compact_after - 1:
            compact_epochs(batch.sparkSession, f"{path}/run={run}", epoch, _one_per_id)

    spark = ratings.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # The query takes the settings along when it starts.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    try:
        changes = latest_ratings(ratings, lateness, kept_days)
        return _start(changes.writeStream.outputMode("update").foreachBatch(save), checkpoint)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _one_per_id(changes: DataFrame) -> DataFrame:
    latest = changes.groupBy("log_id").agg(F.max(F.struct("given_at", "verdict")).alias("last"))
    return latest.select("log_id", "last.verdict", "last.given_at")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, verdict, given_at): the latest rating of every rated log id."""
    return _one_per_id(read_or_empty(spark, path, _LATEST).select("log_id", "verdict", "given_at"))


def with_ratings(log: DataFrame, ratings: DataFrame) -> DataFrame:
    """The log with the streamed ratings in place of its own feedback."""
    rated = log.join(ratings.select(F.col("log_id").alias("id"), "verdict"), "id", "left")
    return rated.withColumn("feedback", F.coalesce("verdict", "feedback")).drop("verdict")
