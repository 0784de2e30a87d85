"""Table reads and writes: all-text bronze, refresh by partition, append of new keys, discovery."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.schema import to_internal
from spendloom.sources.workbook import read_workbooks


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, nothing inferred."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def tag_quarter(df: DataFrame, quarter: str) -> DataFrame:
    return df.withColumn("quarter", F.lit(quarter))


def bronze_from_workbooks(spark: SparkSession, paths: str | list[str], quarter: str) -> DataFrame:
    """One quarter of workbooks as bronze rows."""
    return tag_quarter(to_internal(read_workbooks(spark, paths)), quarter)


def bronze_from_csv(spark: SparkSession, paths: str | list[str], quarter: str) -> DataFrame:
    """One quarter of CSV files as bronze rows; Spark reads CSV as text unless told otherwise."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    return tag_quarter(to_internal(read), quarter)


def bronze_from_parquet(spark: SparkSession, paths: Sequence[str], quarter: str) -> DataFrame:
    return tag_quarter(to_internal(as_text(spark.read.parquet(*paths))), quarter)


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path, which know every store that Spark reads and writes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds anything but markers; what is wrong with a table shows when it is read."""
    store, folder = _folder(spark, path)
    return store.exists(folder) and any(s.getPath().getName()[0] not in "._" for s in store.listStatus(folder))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at the path, or no rows with the given schema where nothing was written yet."""
    if table_exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def refresh_partitions(df: DataFrame, path: str, by: str = "quarter", loaded: Iterable[str] = ()) -> set[str]:
    """Replace the partitions that occur in the frame, and empty those of ``loaded`` that don't; others stay.

    Returns the values that occurred, observed while writing. They are few by nature, such as quarters.
    """
    seen = Observation()
    (
        df.observe(seen, F.collect_set(by).alias("values"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
    written = set(seen.get["values"])
    _drop_partitions(df.sparkSession, path, by, set(loaded) - written)
    return written


def _drop_partitions(spark: SparkSession, path: str, by: str, values: set[str]) -> None:
    """Delete the folders of some partitions."""
    if not values:
        return
    store, folder = _folder(spark, path)
    for status in store.listStatus(folder) if store.exists(folder) else []:
        name, _, value = status.getPath().getName().partition("=")
        if name == by and unquote(value) in values:
            store.delete(status.getPath(), True)


def refresh_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def new_keys(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is known and not stored yet."""
    return incoming.filter(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """The least row of each key, in the order of the other columns."""
    order = W.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in df.columns if c != key] or [key])
    return df.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")


def append_new(incoming: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table lacks, one per key. Running it again with the same rows adds nothing."""
    spark = incoming.sparkSession
    existing = read_or_empty(spark, path, incoming.schema)
    one_per_key(new_keys(incoming, existing, key), key).write.mode("append").parquet(path)


def union_quarters(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column that a quarter lacks is NULL there."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def silver_tables(spark: SparkSession, suffix: str = "awards_typed", schema: str | None = None) -> list[str]:
    """Names of the catalogued tables that end in the suffix."""
    return sorted(t.name for t in spark.catalog.listTables(schema, pattern=f"*{suffix}"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the columns an older table lacks, as name -> (type, default)."""
    missing = {
        name: F.lit(value).cast(kind) for name, (kind, value) in defaults.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df
