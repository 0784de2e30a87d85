"""Postings in blocks with their largest contribution, and an exact ranking that skips blocks by it.

Items lie in buckets by a hash of their id, each bucket of a bounded number of tokens. Inside a bucket the postings of
a term, in order of item, are cut into blocks of ``BLOCK`` postings; a block carries its items' numbers and ids, their
BM25 parts without the term's weight, and the largest part. Blocks lie in partitions by a hash of the term, so a search
reads the partitions of the asked terms only (dynamic partition pruning), and in each the row groups of these terms.

A search meets (bucket, queries) groups by equality joins: blocks of asked terms with the blocks of up to
``QUERY_ROWS`` queries that ask them. A group keeps a running top k per query and returns k rows per query; rows per
(query, item) are neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK = 128
TERM_PARTS = 32
QUERY_ROWS = 1024
SCORE_DIGITS = 6
# Above the difference that rounding scores to ``SCORE_DIGITS`` can make between two of them.
SLACK = 2e-6


def term_part(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


def block_postings(postings: DataFrame, terms: DataFrame, part: Column, buckets: Column, idf: Column) -> DataFrame:
    """(part, term, bucket, idf, docs, ids, parts, top) from ``postings(term, item_id, …)`` and ``terms(term, df)``.

    ``part`` is a posting's contribution before the term's weight ``idf``, ``buckets`` the number of buckets. ``docs``
    numbers the items of a bucket in order of their id, so equal scores rank alike by number and by id.
    """
    placed = postings.select("term", "item_id", part.alias("part")).withColumn(
        "bucket", F.pmod(F.xxhash64("item_id"), buckets).cast("int")
    )
    # A bucket's postings are bounded by its tokens.
    number = F.dense_rank().over(W.partitionBy("bucket").orderBy("item_id")) - 1
    each = F.struct(number.alias("doc"), "item_id", "part")
    lists = placed.withColumn("p", each).groupBy("bucket", "term").agg(F.array_sort(F.collect_list("p")).alias("p"))
    cut = lists.join(terms, "term").select(
        "term", "bucket", idf.alias("idf"), "p", F.explode(F.expr(f"sequence(0, (size(p) - 1) div {BLOCK})")).alias("block")
    )
    cut = cut.withColumn("p", F.slice("p", F.col("block") * BLOCK + 1, BLOCK))
    return cut.select(
        term_part().alias("part"), "term", "bucket", "idf", F.col("p.doc").alias("docs"), F.col("p.item_id").alias("ids"),
        F.col("p.part").alias("parts"), F.array_max("p.part").alias("top"),
    )


class Postings:
    """The blocks of one term in one bucket: items ascending, contributions with the term's weight."""

    __slots__ = ("docs", "parts", "ids", "first", "last", "top", "start", "end", "bound")

    def __init__(self, docs: np.ndarray, parts: np.ndarray, ids: pa.Array, sizes: np.ndarray, top: np.ndarray) -> None:
        self.docs, self.parts, self.ids, self.top = docs, parts, ids, top[sizes > 0]
        sizes = sizes[sizes > 0]
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.first, self.last = docs[self.start], docs[self.end - 1]
        self.bound = float(self.top.max()) if len(self.top) else 0.0


class Bucket:
    """The asked terms of one bucket. ``opened`` counts the blocks that searches looked into, for tests."""

    def __init__(self, blocks: pa.Table, allowed: pa.Array | None = None) -> None:
        self.terms: dict[str, Postings] = {}
        self.opened = 0
        if not blocks.num_rows:
            return
        # A block's first item orders the blocks of a term.
        blocks = blocks.combine_chunks()
        docs = blocks["docs"].combine_chunks()
        first = pa.array(np.asarray(docs.flatten())[np.asarray(docs.offsets)[:-1] - docs.offsets[0].as_py()])
        blocks = blocks.append_column("first", first).sort_by([("term", "ascending"), ("first", "ascending")])
        docs = blocks["docs"].combine_chunks()
        at = np.asarray(docs.offsets) - docs.offsets[0].as_py()
        flat = np.asarray(docs.flatten())
        ids = blocks["ids"].combine_chunks().flatten()
        weight = blocks["idf"].to_numpy()
        parts = np.asarray(blocks["parts"].combine_chunks().flatten()) * np.repeat(weight, np.diff(at))
        top = blocks["top"].to_numpy() * weight
        inside = None if allowed is None else pc.is_in(ids, value_set=allowed).to_numpy(zero_copy_only=False)
        names = blocks["term"].to_pylist()
        edges = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
        for lo, hi in zip(edges, edges[1:]):
            cut, sizes = slice(at[lo], at[hi]), np.diff(at[lo : hi + 1])
            kept = (flat[cut], parts[cut], ids[at[lo] : at[hi]])
            if inside is not None:
                mask = inside[cut]
                sizes = np.add.reduceat(mask.astype(np.int64), at[lo:hi] - at[lo])
                kept = (kept[0][mask], kept[1][mask], kept[2].filter(pa.array(mask)))
            if len(kept[0]):
                self.terms[names[lo]] = Postings(*kept, sizes, top[lo:hi])
        self.scores = np.zeros(int(flat.max()) + 1)

    def best(self, names: Iterable[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(items' numbers, rounded scores) of the k best, ties by number.

        Terms are taken by falling bound. Once the rest of the terms together can't lift an unseen item to the k-th
        score, only seen items go on, and of a further term only blocks that hold one which can still reach it.
        """
        found = sorted((self.terms[n] for n in names if n in self.terms), key=lambda t: -t.bound)
        rest = np.append(np.cumsum([t.bound for t in found][::-1])[::-1], 0.0)
        scores, floor, seen = self.scores, 0.0, None
        for at, term in enumerate(found):
            if seen is None and floor and rest[at] < floor - SLACK:
                seen = np.flatnonzero(scores)
            if seen is None:
                scores[term.docs] += term.parts
                self.opened += len(term.start)
                floor = _kth(scores[scores > 0], k, floor)
            else:
                seen = seen[scores[seen] + rest[at] >= floor - SLACK]
                self._add(term, seen, floor - SLACK - rest[at + 1])
                floor = _kth(scores[seen], k, floor)
        if seen is None:
            seen = np.flatnonzero(scores)
        rounded = np.round(scores[seen], SCORE_DIGITS) + 0.0
        order = np.lexsort((seen, -rounded))[:k]
        for term in found:
            scores[term.docs] = 0.0
        return seen[order], rounded[order]

    def _add(self, term: Postings, seen: np.ndarray, least: float) -> None:
        """Add a term to the items ``seen`` in the blocks where one of them can get to ``least`` by it."""
        low, high = np.searchsorted(seen, term.first), np.searchsorted(seen, term.last, side="right")
        for block in np.flatnonzero(high > low):
            own = seen[low[block] : high[block]]
            if self.scores[own].max() + term.top[block] < least:
                continue
            self.opened += 1
            docs = term.docs[term.start[block] : term.end[block]]
            where = np.searchsorted(docs, own)
            where[where == len(docs)] = 0
            hit = docs[where] == own
            self.scores[own[hit]] += term.parts[term.start[block] + where[hit]]

    def ids_of(self, names: Iterable[str], docs: np.ndarray) -> list:
        """Ids of items that match one of the terms."""
        out: list = [None] * len(docs)
        for name in names:
            if (term := self.terms.get(name)) is not None:
                where = np.searchsorted(term.docs, docs)
                where[where == len(term.docs)] = 0
                for k in np.flatnonzero(term.docs[where] == docs):
                    out[k] = out[k] if out[k] is not None else term.ids[where[k]].as_py()
        return out


def _kth(scores: np.ndarray, k: int, floor: float) -> float:
    return max(floor, float(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else floor


def search(blocks: DataFrame, buckets: Column, asked: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score) of the k best items of each bucket per query.

    ``asked`` has (query_id, terms); several rows of one query ask all their terms. ``scope`` has the allowed item ids.
    """
    id_type, query_type = blocks.schema["ids"].dataType.elementType, asked.schema["query_id"].dataType
    lots = F.greatest(asked.select(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int")).scalar(), F.lit(1))
    asked = asked.select("query_id", "terms", F.pmod(F.xxhash64("query_id"), lots).cast("int").alias("lot"))
    # The comparison lets the planner see that the asked terms select partitions.
    wanted = asked.select(F.explode("terms").alias("term"), "lot").select(term_part().alias("part"), "term", "lot")
    group = ("bucket", "lot")
    stored = blocks.join(wanted.where("part >= 0").distinct(), ["part", "term"])
    stored = stored.select(*group, "term", "idf", "docs", "ids", "parts", "top")
    every_bucket = F.explode(F.sequence(F.lit(0), buckets.cast("int") - 1)).alias("bucket")
    queries = asked.where(F.size("terms") > 0).select("lot", "query_id", "terms", every_bucket)
    queries = queries.withColumn("item_id", F.lit(None).cast(id_type))
    if scope is not None:
        allowed = scope.select(
            F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"),
            F.lit(None).cast(query_type).alias("query_id"), F.lit(None).cast("array<string>").alias("terms"),
            F.pmod(F.xxhash64("item_id"), buckets).cast("int").alias("bucket"), "item_id",
        )
        queries = queries.unionByName(allowed)
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("item_id", id_type), T.StructField("score", T.DoubleType())])
    arrow, scoped = to_arrow_schema(schema), scope is not None

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        of_query = right.filter(pc.is_valid(right["terms"]))
        allowed = pc.drop_null(right["item_id"]).combine_chunks() if scoped else None
        own = Bucket(left, allowed)
        asks: dict = {}
        for query, names in zip(of_query["query_id"].to_pylist(), of_query["terms"].to_pylist()):
            asks.setdefault(query, set()).update(names)
        owners, ids, scores = [], [], []
        for query, names in asks.items():
            names = own.terms.keys() & names
            if names:
                docs, found = own.best(names, k)
                owners += [query] * len(docs)
                ids += own.ids_of(names, docs)
                scores.append(found)
        made = [owners, ids, np.concatenate(scores) if scores else []]
        return pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, arrow)], schema=arrow)

    # Both sides derive from ``asked``; the aliases give this one columns of its own.
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    return stored.groupBy(*group).cogroup(queries.groupBy(*group)).applyInArrow(best, schema)
