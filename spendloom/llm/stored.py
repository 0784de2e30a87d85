"""Cutting lineage in the shared folder, and models that travel once to each Python worker."""

from __future__ import annotations

import pickle
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from spendloom.session import new_folder, shared_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder, so that lost executors lose nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, whose size the planner knows when it chooses a join.

    Shuffle files of the job go with it, instead of staying until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` gave, once no frame that is still to run reads it."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Shipped:
    """A broadcast model with its own code, so that workers need no copy of this package.

    The broadcast value is a box with the pickled bytes, in whose place a worker puts the model on first use; it keeps
    that for its tasks and drops it with the first task that doesn't use it.
    """

    def __init__(self, broadcast) -> None:
        self.broadcast = broadcast

    @property
    def value(self):
        box = self.broadcast.value
        if isinstance(box[0], bytes):
            box[0] = pickle.loads(box[0])
        return box[0]


def shipped(spark: SparkSession, value) -> Shipped:
    """Broadcast of a model whose size its caller bounds; a worker keeps one copy for all its tasks."""
    return Shipped(spark.sparkContext.broadcast([cloudpickle.dumps(value)]))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
