"""Resampling documents towards a target distribution by importance weights over hashed word runs.

Both corpora are counted in ``buckets`` buckets of word runs. A bucket's gain is the scaled logarithm of the ratio of its
smoothed shares in the target and in the corpus; a document's weight is the sum of the gains of its runs, and adding
Gumbel noise from a hash of its id makes the greatest scores a sample without replacement.

Tasks see a document once to count and once to score, as arrays; only sums per bucket leave the first pass. Scores are
written. The cutoff is found by bisection: each step is one exact count over the written scores, for a few thresholds
at once, first on the score, then among the rows that tie on it by doc_id. Only the drawn rows are sorted: they are
dealt by ranges of their order, and a rank is a row's place in its range plus the sizes of the ranges before it.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.llm.stored import shipped, written
from spendloom.llm.textblocks import map_batches, utf8

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
#: Thresholds counted at once by a step of the bisection.
_FAN = 15
#: Bytes of a text that are split at once.
_PIECE = 1 << 22

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut between words into pieces of about ``_PIECE`` bytes."""
    at = 0
    while len(data) - at > _PIECE:
        gap = _GAP.search(data, at + _PIECE)
        if gap is None:
            break
        yield data[at : gap.start()]
        at = gap.start()
    yield data[at:]


class Buckets:
    """Buckets of a text's word runs: crc32 of the run's bytes modulo ``size``."""

    def __init__(self, size: int, longest: int, remembered: int = 200_000) -> None:
        self.size, self.longest, self.remembered = size, longest, remembered
        self.known: dict[bytes, int] = {}

    def of(self, data: bytes) -> tuple[np.ndarray, int]:
        """(buckets of all runs, number of words) of UTF-8 text."""
        known, out, words, tail = self.known, [], 0, []
        for piece in _pieces(data.lower()):
            found = _WORD.findall(piece)
            words += len(found)
            runs = list(found)
            # Runs may begin in the piece before.
            joined = tail + found
            for n in range(2, self.longest + 1):
                first = max(0, len(tail) - n + 1)
                runs += [b" ".join(joined[k : k + n]) for k in range(first, len(joined) - n + 1)]
            tail = joined[len(joined) - self.longest + 1 :] if self.longest > 1 else []
            for run in set(runs).difference(known):
                known[run] = zlib.crc32(run) % self.size
            out.append(np.fromiter(map(known.__getitem__, runs), np.int32, len(runs)))
            if len(known) > self.remembered:
                known.clear()
        return np.concatenate(out), words


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all word runs of ``texts``; buckets without runs are absent."""
    held = shipped(texts.sparkSession, Buckets(buckets, longest))

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            for k in range(batch.num_rows):
                total += np.bincount(held.value.of(data[at[k] : at[k + 1]].tobytes())[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col)).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    # At most one row per bucket: a bound set by a parameter, not by the data.
    out = [0] * buckets
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    all_s, all_t = float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    ratios = [(float(t + 1) * all_s) / (float(s + 1) * all_t) for s, t in zip(corpus, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(seed: int, id_text: str) -> int:
    """floor(-1000 ln(-ln u)) of the uniform number that an id's digest gives."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row of ``docs``.

    Null and empty texts have no words and weight 0; a null id takes the noise of the empty string; repeated rows
    count and score each; extra columns are not read.
    """
    found = [_dense(bucket_counts(t, buckets, longest, text_col), buckets) for t in (docs, target)]
    held = shipped(docs.sparkSession, (Buckets(buckets, longest), gains(*found)))

    def work(batch: pa.RecordBatch):
        own, gain = held.value
        data, at = utf8(batch.column(2))
        n_words, n_features, weight, score = [], [], [], []
        for k, name in enumerate(batch.column(1).to_pylist()):
            runs, words = own.of(data[at[k] : at[k + 1]].tobytes())
            n_words.append(words)
            n_features.append(len(runs))
            weight.append(int(gain[runs].sum()))
            score.append(weight[-1] + noise(seed, name or ""))
        columns = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score)]
        yield pa.record_batch([batch.column(0), *columns], names=["id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).mapInArrow(
        map_batches(work), f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def cutoff(rows: DataFrame, col: str, wanted: int, low: int, high: int) -> tuple[int, int]:
    """(v, n): the least v in [low, high] that at least ``wanted`` rows don't exceed, and the n rows below v.

    One count per step over all rows, for ``_FAN`` thresholds at once; nulls are not counted. ``high`` must be such
    a value.
    """
    below = 0
    while low < high:
        step = max(1, -(-(high - low) // (_FAN + 1)))
        tries = range(low, high, step)
        n = rows.agg(*(F.count_if(F.col(col) <= F.lit(t)).alias(f"n{t}") for t in tries)).first()
        for t, count in zip(tries, n):
            if count >= wanted:
                high = t
                break
            low, below = t + 1, count
    return low, below


def _bounds(rows: DataFrame, col: str) -> tuple[int, int]:
    return tuple(rows.agg(F.min(col), F.max(col)).first())


def ranked(rows: DataFrame, order: list[Column], label: str = "ranked") -> DataFrame:
    """``rows`` with a 1-based ``rank`` in a total order, by ranges; no task holds more than its range."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id counts rows inside a partition in its lower 33 bits.
    placed = placed.withColumn("__range", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed = written(placed, label)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n"))
    # One row per range: at most the number of shuffle partitions.
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    found = placed.join(F.broadcast(before), "__range")
    return found.withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    longest: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row: ``percent`` of the rows with enough words are drawn.

    Drawn are the greatest scores, ties to the smaller id (null ids last), then to fewer runs; what still ties is
    equal in every column returned but the rank. Undrawn rows have a null rank; rows with fewer than ``least_words``
    words are never drawn. Ids must be integers. Empty tables give an empty result, an empty target is legal.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = scored(docs, target, buckets, longest, seed, id_col, text_col)
    # Ascending order everywhere: the greatest score first means the least negated score.
    given = given.select(
        "*", (-F.col("score")).alias("__score"), F.monotonically_increasing_id().alias("__row"),
        F.coalesce(F.col("id").cast("bigint"), F.lit((1 << 63) - 1)).alias("__id"),
    )
    rows = written(given, "scores")
    able = rows.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    if not wanted:
        return rows.select("id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    edge, below = cutoff(able, "__score", wanted, *_bounds(able, "__score"))
    ties = able.where(F.col("__score") == edge)
    edge_id, _ = cutoff(ties, "__id", wanted - below, *_bounds(ties, "__id"))
    # Rows that tie on both are ranked together and cut by their rank.
    first = (F.col("n_words") >= least_words) & (
        (F.col("__score") < edge) | ((F.col("__score") == edge) & (F.col("__id") <= F.lit(edge_id)))
    )
    order = [F.col(c).asc_nulls_last() for c in ("__score", "__id", "id", "n_features", "__row")]
    drawn = ranked(rows.where(first), order, "drawn").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where(~first).withColumn("rank", F.lit(None).cast("bigint"))
    out = drawn.unionByName(rest).select("id", "n_features", "weight", "score", "rank")
    return out.withColumn("id", F.col("id").cast(kind))
