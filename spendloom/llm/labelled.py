"""Bounded samples of labelled documents, and the split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def sample(docs: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, mark) of at most ``size`` rows of ``marks(doc_id, mark)``: those with the least hashed ids.

    Marks are made one per id before; of several texts under one id the least is taken.
    """
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` ids and marks: a bound that the data can't move.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("mark").alias("mark"))
