"""A table that stores each key once and finds out cheaply which keys of a batch it holds already.

Rows lie in folders by a hash of their key. In a hidden folder beside them lie Bloom filters of the stored keys: every bucket has
``words`` words of 64 bits, and a key sets up to six bits of one word. A batch is joined with the filters on (bucket,
word); only keys whose bits are all set may be stored, and only the buckets of such keys are opened for the exact
anti join (dynamic partition pruning). A batch of new keys therefore reads filters and hardly any rows, however large
the sink is.

Every append adds a small filter of its own keys; after ``MERGE_AFTER`` of them they are merged into one base by
bucket, so the number of filter files stays bounded too. Filters are written before rows: what an append leaves
behind if it fails in between makes the filters too wide, never too narrow, so a replay adds each row once. One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.session import new_folder, stored
from spendloom.sources.tables import _folder, one_per_key, table_exists

BUCKETS = 64
WORDS = 1 << 16
MERGE_AFTER = 16
_BITS = 6
# Places of a bucket that parts are cut at.
_PLACES = 1 << 20


def _mask(key: Column) -> Column:
    """Up to six bits of a 64-bit word, chosen by the key's hash."""
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("bigint")
    for k in range(_BITS):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


class KeyedSink:
    """The table at ``path``, keyed by ``key``. ``buckets`` and ``words`` are fixed with the first append."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, words: int = WORDS) -> None:
        self.spark, self.path, self.key, self.buckets, self.words = spark, path, key, buckets, words

    def read(self) -> DataFrame | None:
        """All rows, or None before the first append."""
        return self.spark.read.parquet(self.path).drop("key_bucket") if table_exists(self.spark, self.path) else None

    def clear(self) -> None:
        """Delete all rows and filters, for a table that is built again."""
        store, folder = _folder(self.spark, self.path)
        store.delete(folder, True)

    def _spread(self, batch: DataFrame) -> DataFrame:
        key = F.col(self.key)
        return batch.withColumns(
            {
                "key_bucket": F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"),
                "_word": F.pmod(F.xxhash64(F.lit("word"), key), F.lit(self.words)).cast("int"),
                "_mask": _mask(key),
            }
        )

    def _filter_folders(self) -> tuple[list[str], list[str]]:
        """Names of the finished base and of the finished filters after it, oldest first."""
        store, folder = _folder(self.spark, f"{self.path}/_filters")
        names = []
        for status in store.listStatus(folder) if store.exists(folder) else []:
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if store.exists(done):
                names.append(status.getPath().getName())
        bases = sorted(n for n in names if n.startswith("base"))[-1:]
        since = bases[0].split("-")[1] if bases else ""
        return bases, sorted(n for n in names if n.startswith("more") and n.split("-")[1] > since)

    def _filters(self) -> list[DataFrame]:
        schema = "_word int, _bits bigint, key_bucket int"
        bases, more = self._filter_folders()
        found = [self.spark.read.schema(schema).parquet(f"{self.path}/_filters/{bases[0]}")] if bases else []
        if more:
            found.append(self.spark.read.schema(schema).parquet(*[f"{self.path}/_filters/{n}" for n in more]))
        return found

    def missing(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key is known and not stored, the least row of each key, written aside."""
        known = F.col(self.key).isNotNull()
        given = stored(self._spread(one_per_key(batch.filter(known), self.key)), "batch")
        filters = self._filters()
        if not filters or not table_exists(self.spark, self.path):
            return given
        # The comparisons let the planner see that the batch selects buckets.
        asked = given.select(self.key, "key_bucket", "_word", "_mask").filter("key_bucket >= 0")
        hits = [f.join(asked, ["key_bucket", "_word"]).filter("(_bits & _mask) = _mask").select(self.key, "key_bucket") for f in filters]
        maybe = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        maybe = stored(maybe.distinct(), "maybe-stored")
        rows = self.spark.read.schema(T.StructType([batch.schema[self.key], T.StructField("key_bucket", T.IntegerType())])).parquet(
            self.path
        )
        held = rows.join(maybe.filter("key_bucket >= 0"), ["key_bucket", self.key], "left_semi").select(self.key)
        return given.join(stored(held.distinct(), "stored-keys"), self.key, "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Append the rows whose key the sink lacks, one per key; again with the same rows it adds nothing."""
        self.append_missing(self.missing(batch))

    def append_missing(self, rows: DataFrame) -> None:
        """Append rows that ``missing`` gave, perhaps with other columns by now; their keys are known to be new."""
        rows = stored(self._spread(rows.drop("key_bucket", "_word", "_mask")), "new-rows")
        if rows.isEmpty():
            return
        filters = self._add_filter(rows)
        rows.drop("_word", "_mask").repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(self.path)
        self._merge_many(filters)

    def append_parts(self, rows: DataFrame, size: int, make: Callable[[DataFrame], DataFrame]) -> None:
        """Append ``make(rows)`` of rows that ``missing`` gave, in parts of about ``size`` rows; what a part wrote stays.

        A part is a task that commits its own rows when it is done (Hadoop's committer version 2), whatever becomes of
        the others. The parts are run in rounds of twice as many as before, so a run has few jobs however many parts
        it has, and each round reads only its own rows. A part lies in few buckets, so it writes few files.
        """
        parts = -(-rows.count() // size)
        if not parts:
            return
        spread = self._spread(rows.drop("key_bucket", "_word", "_mask"))
        filters = self._add_filter(spread)
        place = F.col("key_bucket") * F.lit(_PLACES) + F.pmod(F.xxhash64(F.lit("part"), F.col(self.key)), F.lit(_PLACES))
        part = F.floor(place * F.lit(parts) / F.lit(self.buckets * _PLACES)).cast("int")
        # Round r has the parts from 2 ** r - 1 on.
        dealt = spread.withColumn("_part", part).withColumn("_round", F.length(F.bin(F.col("_part") + 1)) - 1)
        path = new_folder(self.spark, "parts")
        dealt.drop("key_bucket", "_word", "_mask").repartition("_round", "_part").write.partitionBy("_round").parquet(path)
        dealt = self.spark.read.parquet(path)
        for k in range(parts.bit_length()):
            first, last = (1 << k) - 1, min((1 << k + 1) - 1, parts)
            own = dealt.filter(F.col("_round") == k).repartitionById(last - first, F.col("_part") - first)
            made = make(own.drop("_part", "_round"))
            self._spread(made).drop("_word", "_mask").write.mode("append").option(
                "mapreduce.fileoutputcommitter.algorithm.version", "2"
            ).partitionBy("key_bucket").parquet(self.path)
        self._merge_many(filters)

    def _add_filter(self, rows: DataFrame) -> list[str]:
        """Write the filter of these keys; the names of all filters by now."""
        bases, more = self._filter_folders()
        last = [int(n.split("-")[1]) for n in (*bases, *more)]
        name = f"more-{max(last, default=0) + 1:09d}"
        own = rows.groupBy("key_bucket", "_word").agg(F.bit_or("_mask").alias("_bits")).select("_word", "_bits", "key_bucket")
        own.sort("key_bucket", "_word").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_filters/{name}")
        return [*bases, *more, name]

    def _merge_many(self, filters: list[str]) -> None:
        if sum(n.startswith("more") for n in filters) >= MERGE_AFTER:
            self._merge(filters[-1].split("-")[1], filters)

    def _merge(self, number: str, old: list[str]) -> None:
        """One base by bucket in place of all filters so far."""
        whole = None
        for f in self._filters():
            whole = f if whole is None else whole.unionByName(f)
        merged = whole.groupBy("key_bucket", "_word").agg(F.bit_or("_bits").alias("_bits"))
        merged.repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(f"{self.path}/_filters/base-{number}")
        for name in old:
            store, folder = _folder(self.spark, f"{self.path}/_filters/{name}")
            store.delete(folder, True)
