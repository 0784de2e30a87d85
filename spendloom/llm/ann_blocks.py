"""Nearest vectors by inner product: a block matrix join with int8 tiles and exact recomputation.

Queries and candidates are dealt into blocks by the hash of their ids; every query block meets every candidate block
in one tile, an equality join on the tile's number. In a tile both sides are quantised to int8 with one scale per
vector, and the integer product bounds the true inner product on both sides by the quantisation error. A candidate
whose upper bound is below the k-th best lower bound of its query can't be in the list; the others are recomputed in
double precision from the original vectors. Each tile keeps k rows per query; a merge over the tiles keeps k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEIGHBOURS = 20
QUERY_ROWS = 2048
CANDIDATE_ROWS = 4096
_CELLS = 1 << 22


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int8 rows, scale of each row): ``m`` is scale * int8 within half a scale per component."""
    scale = np.abs(m).max(axis=1) / 127
    return np.rint(m / scale[:, None]).astype(np.int8), scale


def exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components, so that equal vectors score equally."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * candidates[:, d]
    return total


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query ids, candidate ids, scores) of the ``k`` best candidates of each query, itself left out."""
    q8, qs = quantised(q)
    c8, cs = quantised(c)
    # Integer sums fit float32 exactly while width * 127^2 < 2^24; wider tiles use float64.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    # |x.y - a.b| <= |x - a|.|y| + |a|.|y - b|, with the parts' true norms.
    qe, ce = np.linalg.norm(q - q8 * qs[:, None], axis=1), np.linalg.norm(c - c8 * cs[:, None], axis=1)
    qn, cn = np.linalg.norm(q8 * qs[:, None], axis=1), np.linalg.norm(c, axis=1)
    slack = 1e-9 * (qn + qe)[:, None]
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, _CELLS // max(len(c), 1))
    right, weight = c8.astype(kind).T, cs
    for s in range(0, len(q), step):
        e = min(s + step, len(q))
        middle = (q8[s:e].astype(kind) @ right).astype(np.float64) * (qs[s:e, None] * weight[None, :])
        error = qe[s:e, None] * cn[None, :] + qn[s:e, None] * ce[None, :] + slack[s:e] * cn[None, :]
        own = q_ids[s:e, None] == c_ids[None, :]
        low = np.where(own, -np.inf, middle - error)
        if len(c) > k:
            floor = np.partition(low, len(c) - k, axis=1)[:, len(c) - k]
        else:
            floor = np.full(e - s, -np.inf)
        row, col = np.nonzero((middle + error >= floor[:, None]) & ~own)
        for part in np.array_split(np.arange(len(row)), len(row) // _CELLS + 1):
            score = exact(q[s + row[part]], c[col[part]])
            order = np.lexsort((c_ids[col[part]], -score, row[part]))
            at, score = part[order], score[order]
            first = np.searchsorted(row[at], row[at])
            best = np.arange(len(at)) - first < k
            out.append((q_ids[s + row[at[best]]], c_ids[col[at[best]]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, width) of vectors that aren't null, empty or zero and hold no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("width"), fine.alias("fine"))
    return rows.where("fine and id is not null").drop("fine")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank from 1, id, score): the ``k`` candidates of largest inner product for each query.

    Both frames have ``id_col`` and ``vector_col``. Candidates have the query's width; a query's own id is left out.
    Ties go to the smaller id; fewer candidates give fewer rows; unusable vectors take no part, nor do null ids, and
    empty tables give an empty result. Of rows with one id and different vectors each is a candidate, of fully equal
    rows one.
    """
    rows = usable(vectors, id_col, vector_col).distinct()
    asked = usable(queries, id_col, vector_col).distinct()
    n_rows, n_asked = rows.count(), asked.count()
    across, down = n_rows // CANDIDATE_ROWS + 1, n_asked // QUERY_ROWS + 1
    own = F.xxhash64("id", "vector")
    left = asked.select(
        "id", "vector", "width", F.pmod(own, F.lit(down)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("other")
    ).select("id", "vector", "width", (F.col("block") * across + F.col("other")).alias("tile"))
    right = rows.select(
        "id", "vector", "width", F.pmod(own, F.lit(across)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("other")
    ).select("id", "vector", "width", (F.col("other") * across + F.col("block")).alias("tile"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t["id"].to_numpy()
        flat = pc.list_flatten(t["vector"]).to_numpy().astype(np.float64)
        return ids, flat.reshape(len(ids), -1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = tile(*matrix(a), *matrix(b), k) if a.num_rows and b.num_rows else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    met = left.groupBy("tile", "width").cogroup(right.groupBy("tile", "width")).applyInArrow(
        meet, "query_id bigint, id bigint, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
