"""Spend answers over awards: filters, profiles, rankings, comparisons, savings, extremes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.text import as_display, contains_ci
from spendloom.functions.values import first_usable

# Agencies that are known by an acronym, with the name parts that identify them.
AGENCY_ALIASES: dict[str, tuple[str, ...]] = {
    "DOH": ("department of health", "doh"),
    "DEPED": ("department of education", "deped"),
    "DPWH": ("public works", "dpwh"),
    "PSA": ("philippine statistics authority", "psa"),
    "DSWD": ("social welfare", "dswd"),
}
SMALL_FIRMS = ("Micro", "Small")
ROW_CAP = 100


def all_of(conditions: Sequence[Column]) -> Column | None:
    """AND of the conditions, None without any."""
    return reduce(and_, conditions) if conditions else None


def scope_condition(region: str | None = None, agency: str | None = None) -> Column | None:
    """Region and agency containment, combined only as far as given."""
    given = [
        contains_ci(F.col(name), text)
        for name, text in (("region", region), ("agency", agency))
        if text
    ]
    return all_of(given)


def scoped(awards: DataFrame, region: str | None = None, agency: str | None = None) -> DataFrame:
    condition = scope_condition(region, agency)
    return awards if condition is None else awards.filter(condition)


def agency_is(
    alias: str, column: str = "agency", aliases: Mapping[str, Sequence[str]] = AGENCY_ALIASES
) -> Column:
    """Agency named by acronym or by name: any of the alias's patterns, or the text itself."""
    patterns = aliases.get(alias.upper(), (alias,))
    return reduce(or_, [contains_ci(F.col(column), p) for p in patterns])


def mentions(topic: str, columns: Sequence[str] = ("notice_title", "item_name")) -> Column:
    """Awards on a topic: one of the text columns contains it."""
    return reduce(or_, [contains_ci(F.col(c), topic) for c in columns])


def in_year(year: int, column: str = "award_date") -> Column:
    """A date range instead of year(), so that the scan can skip row groups."""
    c = F.col(column)
    return (c >= F.lit(f"{year}-01-01").cast("date")) & (c < F.lit(f"{year + 1}-01-01").cast("date"))


def between_dates(first: str, last: str, column: str = "award_date") -> Column:
    return F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def in_quarter(quarter: str) -> Column:
    """The partition column, so only that quarter is read."""
    return F.col("quarter") == quarter


def point_aggregate(awards: DataFrame, *conditions: Column) -> DataFrame:
    """Total spend and contract count of the filtered awards; zeros when none match."""
    condition = all_of(conditions)
    rows = awards if condition is None else awards.filter(condition)
    return rows.agg(
        F.coalesce(F.sum("contract_amount").cast("double"), F.lit(0.0)).alias("total_spend"),
        F.count(F.lit(1)).alias("contract_count"),
    )


def spend_totals(awards: DataFrame) -> DataFrame:
    """Sum, count and mean of the amounts, zeros for no rows."""
    return awards.agg(
        F.coalesce(F.sum("contract_amount").cast("double"), F.lit(0.0)).alias("total_spend"),
        F.count(F.lit(1)).alias("award_count"),
        F.coalesce(F.avg("contract_amount").cast("double"), F.lit(0.0)).alias("avg_spend"),
    )


def _grouped(awards: DataFrame, dimension: str) -> DataFrame:
    return awards.groupBy(dimension).agg(
        F.count(F.lit(1)).alias("contracts"),
        F.round(F.sum("contract_amount"), 2).cast("double").alias("total_spend"),
        F.round(F.avg("contract_amount"), 2).cast("double").alias("avg_contract"),
    )


def profile(awards: DataFrame, dimension: str, limit: int = 20) -> DataFrame:
    """Contracts, spend and mean contract per value of a dimension, largest spend first."""
    return (
        _grouped(awards, dimension)
        .orderBy(F.desc_nulls_last("total_spend"), F.asc_nulls_last(dimension))
        .limit(limit)
    )


def leaderboard(awards: DataFrame, entity: str, limit: int = 10, known_only: bool = True) -> DataFrame:
    """Entities by total spend."""
    rows = awards.filter(F.col(entity).isNotNull()) if known_only else awards
    return (
        _grouped(rows, entity)
        .drop("avg_contract")
        .orderBy(F.desc_nulls_last("total_spend"), F.asc_nulls_last(entity))
        .limit(limit)
    )


def compare(awards: DataFrame, dimension: str, values: Sequence[str]) -> DataFrame:
    """Spend and count of the compared values of a dimension."""
    return _grouped(awards.filter(F.col(dimension).isin(*values)), dimension).drop("avg_contract")


def budget_savings(awards: DataFrame) -> DataFrame:
    """Budget above the awarded amount, over the awards that stayed below their budget."""
    saved = F.col("approved_budget") - F.col("contract_amount")
    below = awards.filter(F.col("approved_budget") > F.col("contract_amount"))
    return below.agg(
        F.coalesce(F.sum(saved).cast("double"), F.lit(0.0)).alias("total_savings"),
        F.count(F.lit(1)).alias("contract_count"),
    )


def largest_contracts(awards: DataFrame, limit: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """Highest amounts first; remaining columns break ties, so the choice is stable."""
    shown = list(
        columns
        or ("award_ref", "agency", "awardee", "contract_amount", "award_date", "region", "notice_title", "item_name")
    )
    ties = [F.asc_nulls_last(c) for c in shown if c != "contract_amount"]
    return awards.select(*shown).orderBy(F.desc_nulls_last("contract_amount"), *ties).limit(limit)


def answer_totals(rows: DataFrame, money_columns: Sequence[str]) -> DataFrame:
    """Sum over answer rows of the first usable money column, and its mean over all rows."""
    present = [F.col(c) for c in money_columns if c in rows.columns]
    amount = first_usable(*present) if present else F.lit(None).cast("double")
    count = F.count(F.lit(1))
    total = F.coalesce(F.sum(amount), F.lit(0.0))
    return rows.agg(
        total.alias("total_spend"),
        count.alias("award_count"),
        F.when(count > 0, total / count).otherwise(0.0).alias("avg_spend"),
    )


def display_rows(df: DataFrame) -> DataFrame:
    """Cells as shown to a user: numbers as they are, other values as text, NULL as empty text."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return df.select(
        *[as_display(F.col(f"`{name}`"), kind in numeric).alias(name) for name, kind in df.dtypes]
    )
