"""Distinct counts that can be merged: one stored sketch per group, unioned when read.

A sketch has a fixed size whatever it has seen, so a new quarter adds its own and no earlier row is read again. Counts
are estimates; ``bound`` is three standard errors of them, beside which exact counts can be put.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def relative_bound(lg_k: int = LG_K) -> float:
    """Three standard errors of an estimate, as a share of it."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)


def key_sketches(rows: DataFrame, key: str, by: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """One row per group: (by, sketch) over the keys that aren't null. Partial sketches are made before the shuffle."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(key), lg_k).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups, or of everything, out of stored ones."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: str = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def checked_estimates(sketches: DataFrame, exact: DataFrame, by: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(by, exact, estimate, within): whether the estimate is as close to the exact count as its bound says."""
    both = exact.join(merged(sketches, by).withColumn("estimate", estimate()), list(by)).drop("sketch")
    return both.withColumn("within", F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.col("exact") * relative_bound(lg_k), F.lit(1.0)))
