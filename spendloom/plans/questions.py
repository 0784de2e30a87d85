"""Named questions over the awards, as parameterised frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.functions.text import contains_ci
from spendloom.operators.analytics import (
    AGENCY_ALIASES,
    SMALL_FIRMS,
    agency_is,
    budget_savings,
    compare,
    in_quarter,
    in_year,
    largest_contracts,
    leaderboard,
    mentions,
    point_aggregate,
    profile,
)

Aliases = Mapping[str, Sequence[str]]


def top_suppliers(
    awards: DataFrame,
    agency: str,
    year: int | None = None,
    topic: str | None = None,
    limit: int = 10,
    aliases: Aliases = AGENCY_ALIASES,
) -> DataFrame:
    """Suppliers of an agency by awarded amount, optionally in a year or on a topic."""
    rows = awards.filter(agency_is(agency, aliases=aliases))
    if year is not None:
        rows = rows.filter(in_year(year))
    if topic is not None:
        rows = rows.filter(mentions(topic))
    return leaderboard(rows, "awardee", limit)


def agency_spend(
    awards: DataFrame, agency: str, quarter: str | None = None, aliases: Aliases = AGENCY_ALIASES
) -> DataFrame:
    conditions = [agency_is(agency, aliases=aliases)]
    if quarter is not None:
        conditions.append(in_quarter(quarter))
    return point_aggregate(awards, *conditions)


def largest_in_region(awards: DataFrame, region: str, limit: int = 1) -> DataFrame:
    return largest_contracts(awards.filter(contains_ci(F.col("region"), region)), limit)


def compare_classifications(awards: DataFrame, *values: str) -> DataFrame:
    return compare(awards, "classification", values)


def compare_modes(awards: DataFrame, *values: str) -> DataFrame:
    return compare(awards, "procurement_mode", values)


def small_firm_contracts(awards: DataFrame, limit: int = 5) -> DataFrame:
    shown = ("award_ref", "awardee", "awardee_size", "agency", "contract_amount", "award_date")
    return largest_contracts(awards.filter(F.col("awardee_size").isin(*SMALL_FIRMS)), limit, shown)


def savings(awards: DataFrame) -> DataFrame:
    return budget_savings(awards)


def supplier_contracts(awards: DataFrame, supplier: str) -> DataFrame:
    return point_aggregate(awards, contains_ci(F.col("awardee"), supplier))


def city_spend(awards: DataFrame, city: str) -> DataFrame:
    return point_aggregate(awards, contains_ci(F.col("city"), city))


def agency_profile(
    awards: DataFrame, agency: str, dimension: str = "classification", aliases: Aliases = AGENCY_ALIASES
) -> DataFrame:
    return profile(awards.filter(agency_is(agency, aliases=aliases)), dimension)


def branch_spend(awards: DataFrame) -> DataFrame:
    return leaderboard(awards, "government_branch")


def largest_on_topic(
    awards: DataFrame,
    topic: str,
    agency: str | None = None,
    limit: int = 5,
    aliases: Aliases = AGENCY_ALIASES,
) -> DataFrame:
    rows = awards.filter(mentions(topic))
    if agency is not None:
        rows = rows.filter(agency_is(agency, aliases=aliases))
    return largest_contracts(rows, limit)


def topic_spend(awards: DataFrame, topic: str) -> DataFrame:
    return point_aggregate(awards, mentions(topic))


def largest_by_organisation(
    awards: DataFrame, groups: Sequence[str], classifications: Sequence[str], limit: int = 5
) -> DataFrame:
    """Largest contracts of some organisation groups in some classifications."""
    rows = awards.filter(F.col("org_group").isin(*groups) & F.col("classification").isin(*classifications))
    return largest_contracts(rows, limit)
