"""Item catalogue and consolidated awards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.functions.text import item_key
from spendloom.schema import CATALOGUE_COLUMNS, ITEM_TEXT
from spendloom.sources.tables import new_keys


def with_item_id(awards: DataFrame) -> DataFrame:
    """Awards with their item key, NULL where a text part is missing."""
    key = item_key(*[F.col(c) for c in ITEM_TEXT])
    rest = [F.col(f"`{c}`") for c in awards.columns if c != "item_id"]
    return awards.select(key.alias("item_id"), *rest)


def unique_items(awards: DataFrame) -> DataFrame:
    """One row per known item key: the first in text order.

    The rank-1 filter is applied inside each task before the shuffle (window group limit), so an item that
    a third of all awards share sends one row per task.
    """
    # the key is NULL exactly where a text part is; testing the parts keeps the hash out of pushed filters
    complete = awards.dropna(subset=list(ITEM_TEXT))
    keyed = with_item_id(complete).select(*CATALOGUE_COLUMNS)
    order = [F.asc_nulls_last(c) for c in CATALOGUE_COLUMNS[1:]]
    first = F.row_number().over(W.partitionBy("item_id").orderBy(*order))
    return keyed.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def new_items(awards: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Items of these awards that the catalogue does not hold yet."""
    return new_keys(unique_items(awards), catalogue, "item_id")


def keyless_awards(awards: DataFrame) -> DataFrame:
    """How many awards have no item key and therefore no catalogue entry."""
    return with_item_id(awards).agg(
        F.count(F.lit(1)).alias("awards"), F.count_if(F.col("item_id").isNull()).alias("without_item_id")
    )


def catalogue_view(items: DataFrame) -> DataFrame:
    """The six published catalogue columns."""
    return items.select(*CATALOGUE_COLUMNS)


def largest_award_per_item(awards: DataFrame) -> DataFrame:
    """The award with the highest amount for each item."""
    order = [
        F.desc_nulls_last("contract_amount"),
        *[F.asc_nulls_last(c) for c in ("award_ref", "agency", "awardee", "region")],
    ]
    first = F.row_number().over(W.partitionBy("item_id").orderBy(*order))
    return (
        awards.filter(F.col("item_id").isNotNull())
        .select("item_id", "agency", "region", "awardee", "award_ref", "contract_amount")
        .withColumn("_rn", first)
        .filter("_rn = 1")
        .drop("_rn")
    )
