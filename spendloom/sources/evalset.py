"""JSON evaluation sets and result summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("question", "target_item_id", "target_item_name", "category", "source")
    ]
)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, so the set stays splittable."""
    df.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Evaluation records; ``array_file`` reads a file that is one JSON array."""
    return spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=array_file)
