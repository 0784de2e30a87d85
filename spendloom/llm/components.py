"""Connected components by alternating large and small stars, without driver-side graphs.

Every round replaces each node's neighbours by links to the least of them, once for the greater and once for the
lesser neighbours; the links end as stars around the least node of each component. Rounds grow with the logarithm
of the longest chain. A hot node's links are dealt by joins, which adaptive execution splits; none is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.stored import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a and b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links(a, b)``; root is the least node of its component.

    Loops (a = b) give the node itself. Repeated links count once; without links the result is empty. Rows with a
    null end are left out.
    """
    given = links.select("a", "b").where("a is not null and b is not null")
    now = cut(given.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_large_star(now).distinct()).distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    loops = given.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    return found.union(loops).groupBy("node").agg(F.min("root").alias("root"))
