"""The quarterly load: bronze, silver, quality gate, catalogue, gold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.operators.catalogue import new_items, unique_items, with_item_id
from spendloom.operators.embedding import EMBEDDING_SCHEMA
from spendloom.operators.quality import quality_checks, run_quality_gate
from spendloom.operators.silver import deduplicate, split_by_grain, type_and_clean, zero_amounts
from spendloom.schema import CATALOGUE_COLUMNS
from spendloom.sources.tables import append_new, read_or_empty, refresh_partitions, table_exists

CATALOGUE_SCHEMA = ", ".join(f"{c} string" for c in CATALOGUE_COLUMNS)


class Lake:
    """Paths of the tables below one root folder; all but the catalogue are partitioned by quarter."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, quarters: list[str] | None = None) -> DataFrame:
        df = self.spark.read.option("mergeSchema", True).parquet(self.path(name))
        return df.filter(F.col("quarter").isin(quarters)) if quarters else df

    def save(self, df: DataFrame, name: str, loaded: Iterable[str] = ()) -> set[str]:
        return refresh_partitions(df, self.path(name), loaded=loaded)


def load_quarters(
    lake: Lake, bronze: DataFrame, strict: bool = True, quarters: list[str] | None = None
) -> bool:
    """Load the quarters of the bronze rows; rerunning a quarter replaces it in every table, with no rows if need be.

    ``quarters`` names quarters that are loaded even where bronze has no row of them. Each stage is a written table,
    so a later stage reads columns instead of repeating the earlier work, and bronze is read once. The gate runs
    before the catalogue and gold are touched, and stops the load when strict.
    """
    loaded = sorted(lake.save(bronze, "bronze", quarters or ()) | set(quarters or ()))
    raw = lake.read("bronze", loaded)
    awards_raw, quarantine = split_by_grain(raw)
    lake.save(awards_raw, "awards_raw", loaded)
    lake.save(quarantine, "quarantine_no_award", loaded)
    lake.save(deduplicate(_or_empty(lake, "awards_raw", raw, loaded)), "awards_deduped", loaded)
    deduped = _or_empty(lake, "awards_deduped", raw, loaded)
    lake.save(type_and_clean(deduped), "awards_typed", loaded)
    lake.save(zero_amounts(deduped), "awards_zero_amount", loaded)
    typed = _or_empty(lake, "awards_typed", type_and_clean(deduped), loaded)
    stored = read_or_empty(lake.spark, lake.path("unique_items"), CATALOGUE_SCHEMA)
    items = stored.unionByName(new_items(typed, stored))
    checks = quality_checks(
        typed=typed,
        bronze=raw,
        awards_raw=_or_empty(lake, "awards_raw", raw, loaded),
        quarantine=_or_empty(lake, "quarantine_no_award", raw, loaded),
        deduped=deduped,
        zero_amount=_or_empty(lake, "awards_zero_amount", raw, loaded),
        catalogue=_with_vectors(lake, items),
    )
    passed = run_quality_gate(checks, strict)
    append_new(unique_items(typed), lake.path("unique_items"), "item_id")
    lake.save(gold_layout(with_item_id(typed)), "all_awards", loaded)
    return passed


def _with_vectors(lake: Lake, items: DataFrame) -> DataFrame:
    """Items with their stored vectors, null before the first; without the column where the stored table lacks it."""
    vectors = read_or_empty(lake.spark, lake.path("item_embeddings"), EMBEDDING_SCHEMA)
    stored = [c for c in ("item_id", "embedding") if c in vectors.columns]
    return items.join(vectors.select(*stored), "item_id", "left") if "item_id" in stored else items


def gold_layout(awards: DataFrame) -> DataFrame:
    """Awards in item order inside each quarter, so that lookups of items skip files; the award reference
    splits an item that fills many files."""
    keys = ("quarter", "item_id", "award_ref")
    return awards.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _or_empty(lake: Lake, name: str, like: DataFrame, quarters: list[str]) -> DataFrame:
    stored = lake.read(name) if table_exists(lake.spark, lake.path(name)) else lake.spark.createDataFrame([], like.schema)
    return stored.filter(F.col("quarter").isin(quarters))
