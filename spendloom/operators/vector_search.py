"""Cosine search: exact over every vector in tiles, and approximate over cells.

Queries and corpus are dealt into blocks by a hash of their id. Each corpus block meets each query block in a tile, by an
equality join on the tile's two numbers; a tile multiplies two bounded matrices and returns k rows per query. Nothing
is collected, and the corpus is read once whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from spendloom.operators.text_index import SCORE_DIGITS, rank_results

#: Queries and corpus vectors of a tile. A vector moves once per block of the other side.
BLOCK_ROWS = 16_384
CORPUS_ROWS = 32_768
CELL_SLICE_ROWS = 32_768
#: Few rows are cut into up to so many blocks of a part of that, so that all tasks have a tile.
LEAST_BLOCKS = 8
SMALLER = 16
#: Queries multiplied at once inside a tile, items of the first products of a query, and products taken again at once.
_STEP = 256
_FIRST_ITEMS = 1024
_EXACT = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; rows of unequal width are an error."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(column) and flat.size % len(column):
        raise ValueError("vectors of different width in one table")
    width = flat.size // max(len(column), 1)
    if len(column) and not np.all(np.diff(np.asarray(column.offsets)) == width):
        raise ValueError("vectors of different width in one table")
    return flat.reshape(len(column), width)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by lowest id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores >= floor)
    else:
        chosen = np.arange(len(scores))
    order = np.lexsort((ids[chosen], -scores[chosen]))
    return chosen[order][:k]


class _TopK:
    """Running k best (id, score) per query."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.ids: list[np.ndarray | None] = [None] * n_queries
        self.scores: list[np.ndarray | None] = [None] * n_queries

    def add(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray | range) -> None:
        """``scores`` has one row per query position in ``queries`` and one column per id."""
        for row, q in enumerate(queries):
            new_ids, new_scores = ids, scores[row]
            at = _best(new_ids, new_scores, self.k)
            new_ids, new_scores = new_ids[at], new_scores[at]
            if self.ids[q] is not None:
                new_ids = np.concatenate([self.ids[q], new_ids])
                new_scores = np.concatenate([self.scores[q], new_scores])
                at = _best(new_ids, new_scores, self.k)
                new_ids, new_scores = new_ids[at], new_scores[at]
            self.ids[q], self.scores[q] = new_ids, new_scores

    def batches(self, query_ids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for q, (ids, scores) in enumerate(zip(self.ids, self.scores, strict=True)):
            if ids is not None and len(ids):
                owner = np.repeat(query_ids[q : q + 1], len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip((owner, ids, scores), schema, strict=True)],
                    schema=schema,
                )


def _result_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("item_id", id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _usable(df: DataFrame, column: str) -> DataFrame:
    """Rows with a vector that has length; a zero vector has no direction to compare."""
    longest = F.array_max(F.transform(F.col(column), lambda v: F.abs(v)))
    return df.filter(F.col(column).isNotNull() & (longest > 0))


def _tile_top(items: pa.Table, asked: pa.Table, k: int, arrow: pa.Schema) -> pa.Table:
    """The k best items of a tile per query."""
    if not items.num_rows or not asked.num_rows:
        return arrow.empty_table()
    items, asked = items.combine_chunks(), asked.combine_chunks()
    ids, owners = items["item_id"].to_numpy(), asked["query_id"].to_numpy()
    vectors, wanted = _matrix(items["embedding"].combine_chunks()), _matrix(asked["query_vector"].combine_chunks())
    if vectors.shape[1] != wanted.shape[1]:
        raise ValueError(f"query width {wanted.shape[1]}, corpus width {vectors.shape[1]}")
    vectors, wanted = _unit(vectors), _unit(wanted)
    if np.isfinite(vectors).all() and np.isfinite(wanted).all():
        at, best, scores = _top_by_bounds(vectors, wanted, ids, k)
        columns = zip((owners[at], ids[best], scores), arrow, strict=True)
        return pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in columns], schema=arrow)
    top = _TopK(len(owners), k)
    for at in range(0, len(owners), _STEP):
        scores = np.round(wanted[at : at + _STEP] @ vectors.T, SCORE_DIGITS) + 0.0
        top.add(ids, scores, range(at, min(at + _STEP, len(owners))))
    return pa.Table.from_batches(list(top.batches(owners, arrow)), schema=arrow)


def _top_by_bounds(vectors: np.ndarray, wanted: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of the k best items per query, ties by lowest id; queries and items as positions.

    All products are taken in single precision; those that can't reach the k-th best score so far, by more than single
    precision and rounding may err, are passed over, and the others are taken again in double precision.
    """
    # Of unit vectors; rounding moves both of two scores that are compared by half a digit.
    err = (vectors.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    short, found = vectors.astype(np.float32), []
    edges = [0]
    while edges[-1] < len(vectors):
        edges.append(min(len(vectors), max(4 * edges[-1], _FIRST_ITEMS, k)))
    for at in range(0, len(wanted), _STEP):
        asked = wanted[at : at + _STEP]
        narrow = asked.astype(np.float32)
        own, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(asked), -np.inf, np.float32)
        for low, high in zip(edges, edges[1:]):
            near = narrow @ short[low:high].T
            if not low and high > k:
                floor = np.partition(near, high - k, axis=1)[:, high - k] - np.float32(2 * err)
            q, i = np.nonzero(near >= floor[:, None])
            i += low
            exact = np.concatenate([np.einsum("ij,ij->i", asked[q[n : n + _EXACT]], vectors[i[n : n + _EXACT]]) for n in range(0, max(len(q), 1), _EXACT)])
            own, item = np.concatenate([own, q]), np.concatenate([item, i])
            score = np.concatenate([score, np.round(exact, SCORE_DIGITS) + 0.0])
            by = np.lexsort((place[item], -score, own))
            own, item, score = own[by], item[by], score[by]
            begin = np.searchsorted(own, np.arange(len(asked)))
            first = np.arange(len(own)) - begin[own] < k
            own, item, score = own[first], item[first], score[first]
            many = np.bincount(own, minlength=len(asked))
            full = np.flatnonzero(many == k)
            floor[full] = score[np.searchsorted(own, full) + k - 1] - 2 * err
        found.append((own + at, item, score))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tiles(rows: int) -> Column:
    """Number of blocks of at most about ``rows`` rows on one side of the tiles, as an aggregate."""
    n = F.count(F.lit(1))
    few = F.least(F.ceil(n * F.lit(SMALLER) / F.lit(rows)), F.lit(LEAST_BLOCKS).cast("bigint"))
    return F.greatest(F.ceil(n / F.lit(rows)), few, F.lit(1).cast("bigint")).cast("int")


def _blocks_of(df: DataFrame, rows: int) -> Column:
    """Number of blocks of about ``rows`` rows, as a subquery of the plan."""
    return F.greatest(df.select(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int")).scalar(), F.lit(1))


def vector_search(
    corpus: DataFrame, queries: DataFrame, k: int = 20, scope: DataFrame | None = None
) -> DataFrame:
    """Exact top k items per query by cosine: (query_id, item_id, score, rank, source).

    ``corpus`` has (item_id, embedding), ``queries`` (query_id, query_vector). ``scope`` holds the allowed item ids, or
    is the catalogue itself, and applies before the ranking, so no rank goes to an item outside. Equal rows of
    ``queries`` count once.
    """
    kept = _usable(corpus.select("item_id", "embedding"), "embedding")
    if scope is not None:
        kept = kept.join(scope.select("item_id"), "item_id", "left_semi")
    asked = _usable(queries.select("query_id", "query_vector"), "query_vector").distinct()
    schema = _result_schema(queries.schema["query_id"].dataType, corpus.schema["item_id"].dataType)
    arrow = to_arrow_schema(schema)
    n_corpus, n_asked = corpus.select(_tiles(CORPUS_ROWS)).scalar(), queries.select(_tiles(BLOCK_ROWS)).scalar()

    def dealt(df: DataFrame, own: str, n_own: Column, other: str, n_other: Column, *hashed: str) -> DataFrame:
        """Each row in its own block, once per block of the other side."""
        block = F.pmod(F.xxhash64(*hashed), n_own).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1)))

    stored = dealt(kept, "corpus_block", n_corpus, "query_block", n_asked, "item_id")
    wanted = dealt(asked, "query_block", n_asked, "corpus_block", n_corpus, "query_id", "query_vector")
    # Corpus and queries may be the same frame; the aliases give the queries columns of their own.
    wanted = wanted.select(*[F.col(c).alias(c) for c in wanted.columns])
    tile = ("corpus_block", "query_block")
    found = stored.groupBy(*tile).cogroup(wanted.groupBy(*tile)).applyInArrow(lambda items, asks: _tile_top(items, asks, k, arrow), schema)
    return rank_results(found, k, "vector")


# ── approximate search ────────────────────────────────────────────────────────────────────────────────


def train_cells(corpus: DataFrame, n_cells: int, seed: int = 7, sample: int | None = None) -> np.ndarray:
    """Unit centroids of the corpus directions, found by Spark's k-means over all or ``sample`` of its vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    kept = _usable(corpus, "embedding")
    if sample is not None:
        kept = kept.orderBy(F.xxhash64("item_id"), "item_id").limit(sample)
    features = kept.select(array_to_vector("embedding").alias("features"))
    means = KMeans(k=n_cells, seed=seed, maxIter=10, distanceMeasure="cosine")
    return _unit(np.array(means.fit(features).clusterCenters(), dtype=np.float64))


def _nearest_cells(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """One row per (row, probed cell), nearest cells first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    key_type = df.schema[key].dataType
    key_arrow = to_arrow_type(key_type)
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField(vector, T.ArrayType(T.FloatType())),
            T.StructField("cell", T.IntegerType()),
        ]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column(1)) @ shared.value.T), axis=1, kind="stable")
                near = near[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at).cast(key_arrow),
                        batch.column(1).take(at).cast(pa.list_(pa.float32())),
                        pa.array(near.ravel().astype(np.int32)),
                    ],
                    names=[key, vector, "cell"],
                )

    return _usable(df.select(key, vector), vector).mapInArrow(assign, schema)


def approximate_search(
    corpus: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = 20, probes: int = 4
) -> DataFrame:
    """Top k among the items of the cells nearest to each query, scored exactly."""
    cells = _nearest_cells(corpus, "item_id", "embedding", centroids, 1)
    asked = _nearest_cells(queries, "query_id", "query_vector", centroids, probes)
    return rank_results(cell_search(cells, asked, k), k, "vector")


def cell_search(cells: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score) of the k best of each slice of a cell per query.

    ``cells`` has (item_id, embedding, cell), ``asked`` a row (query_id, query_vector, cell) per probed cell. Cells are cut
    into slices of about ``CELL_SLICE_ROWS`` items and blocks of about ``BLOCK_ROWS`` queries, so a crowded or much asked
    cell is many groups.
    """

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        """One small row per cell."""
        return df.groupBy("cell").agg(_tiles(size).alias(name))

    def own(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    cut = parts(cells, CELL_SLICE_ROWS, "slices").join(parts(asked, BLOCK_ROWS, "blocks"), "cell")
    stored = cells.join(cut, "cell").withColumn("slice", own("item_id", "slices")).withColumn("block", every("blocks"))
    probed = asked.join(cut, "cell").withColumn("block", own("query_id", "blocks")).withColumn("slice", every("slices"))
    schema = _result_schema(asked.schema["query_id"].dataType, cells.schema["item_id"].dataType)
    arrow = to_arrow_schema(schema)
    group = ("cell", "slice", "block")
    wanted = probed.select(*[F.col(c).alias(c) for c in (*group, "query_id", "query_vector")])
    return (
        stored.select(*group, "item_id", "embedding")
        .groupBy(*group)
        .cogroup(wanted.groupBy(*group))
        .applyInArrow(lambda items, asks: _tile_top(items, asks, k, arrow), schema)
    )


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate search returned, per query."""
    hit = approximate.select("query_id", "item_id", F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    )
