"""Query log: schema, feedback, key figures, recent rows, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.functions.values import call_cost, normal_feedback
from spendloom.sources.tables import append_new, with_defaults

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("matched_items_count", T.LongType()),
        T.StructField("total_spend", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("used_vector", T.IntegerType()),
        T.StructField("used_llm", T.IntegerType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
    ]
)
# Columns that logs written before token accounting lack.
LOG_DEFAULTS = {
    "feedback": ("string", None),
    "prompt_tokens": ("bigint", 0),
    "total_tokens": ("bigint", 0),
    "cost_usd": ("double", 0.0),
}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with every column, older files included."""
    merged = with_defaults(spark.read.option("mergeSchema", True).parquet(path), LOG_DEFAULTS)
    filled = {n: v for n, (_, v) in LOG_DEFAULTS.items() if v is not None}
    return merged.fillna(filled).select(*LOG_SCHEMA.fieldNames())


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows; ids come from whoever asked the query, and an id is stored once."""
    append_new(rows, path, "id")


def with_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """The log with the latest feedback per id. ``feedback`` has (log_id, feedback, given_at).

    Feedback is only ever appended. The latest per id is a partial aggregate, so an id with very many
    entries is reduced before the shuffle.
    """
    latest = feedback.groupBy("log_id").agg(
        F.max(F.struct("given_at", normal_feedback(F.col("feedback")).alias("verdict"))).alias("last")
    )
    joined = log.join(latest.withColumnRenamed("log_id", "id"), "id", "left")
    return joined.withColumn("feedback", F.coalesce(F.col("last.verdict"), F.col("feedback"))).drop("last")


def _up():
    return F.count_if(F.lower("feedback").contains("up"))


def _down():
    return F.count_if(F.lower("feedback").contains("down"))


def key_figures(log: DataFrame) -> DataFrame:
    """Counts, mean latency, tokens, cost and approval in one row; approval is 100 while nothing is rated."""
    up, down = _up(), _down()
    return log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        up.alias("thumbs_up"),
        down.alias("thumbs_down"),
        F.when(up + down > 0, up / (up + down) * 100.0).otherwise(100.0).alias("satisfaction_rate"),
    )


def feedback_split(log: DataFrame) -> DataFrame:
    """Helpful, poor and unrated queries."""
    counted = log.agg(F.count(F.lit(1)).alias("n"), _up().alias("up"), _down().alias("down"))
    unrated = F.greatest(F.lit(0).cast("bigint"), F.col("n") - F.col("up") - F.col("down"))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("status"), value.alias("queries"))
            for name, value in (("helpful", F.col("up")), ("poor", F.col("down")), ("unrated", unrated))
        ]
    )
    return counted.select(F.inline(rows))


def recent_queries(log: DataFrame, limit: int = 150) -> DataFrame:
    """The newest log rows, ready to show."""
    return (
        log.select(
            "id",
            "timestamp",
            "query",
            F.round("latency_ms", 0).alias("latency_ms"),
            F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
            F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
            F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            F.coalesce("feedback", F.lit("None")).alias("feedback"),
        )
        .orderBy(F.desc("id"))
        .limit(limit)
    )


def latest_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    columns = (
        "id", "timestamp", "query", "prompt_tokens", "total_tokens", "cost_usd", "latency_ms", "feedback",
    )
    return log.select(*columns).orderBy(F.desc("id")).limit(limit)


def latency_series(log: DataFrame) -> DataFrame:
    """Latency by log id, in order."""
    return log.select("id", "latency_ms").orderBy("id")


def with_cost(log: DataFrame) -> DataFrame:
    """Cost of each logged call from its prompt and completion tokens."""
    completion = F.col("total_tokens") - F.col("prompt_tokens")
    return log.withColumn("cost_usd", call_cost(F.col("prompt_tokens"), completion))


def cost_by(log: DataFrame, dimension: str) -> DataFrame:
    """Calls, tokens and cost per value; cost comes from the token sums, so its order does not matter."""
    completion = F.sum("total_tokens") - F.sum("prompt_tokens")
    return log.groupBy(dimension).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(call_cost(F.sum("prompt_tokens"), completion), 8).alias("cost_usd"),
    )
