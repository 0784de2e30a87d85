"""Spend of retrieved items: totals, top agencies, top regions and sample awards, per query.

The report is one long frame ``(query_id, section, position, name, award_count, spend)`` with the sections
total, agency and region; one pass with grouping sets computes all three. Awards of the asked items are summed
per (item, agency, region) before they meet the queries, with partial sums inside each task, so an item that
a third of all awards share and every query asks for is added up once, not once per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.functions.text import peso
from spendloom.operators.analytics import scoped
from spendloom.session import stored

TOP = 5
SAMPLE_COLUMNS = (
    "award_ref", "agency", "awardee", "contract_amount", "award_date", "region", "notice_title", "item_name",
)
SAMPLE_ROW = (*SAMPLE_COLUMNS, "position")
REPORT_COLUMNS = ("section", "position", "name", "award_count", "spend")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "agency", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("contract_amount").alias("amount")
    )


def _report(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and top lists of the partial sums, for each value of the keys (none: over all rows)."""
    base = [F.col(k) for k in keys]
    rolled = sums.groupingSets(
        [base, [*base, F.col("agency")], [*base, F.col("region")]], *base, F.col("agency"), F.col("region")
    ).agg(
        F.grouping("agency").alias("_a"),
        F.grouping("region").alias("_r"),
        F.sum("n").alias("award_count"),
        F.sum("amount").alias("amount"),
    )
    section = F.when(F.col("_a") == 0, "agency").when(F.col("_r") == 0, "region").otherwise("total")
    named = rolled.select(
        *base,
        section.alias("section"),
        F.when(F.col("_a") == 0, F.col("agency")).when(F.col("_r") == 0, F.col("region")).alias("name"),
        "award_count",
        "amount",
    )
    order = W.partitionBy(*keys, "section").orderBy(F.desc_nulls_last("amount"), F.asc_nulls_last("name"))
    return (
        named.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= TOP)
        .select(
            *base,
            "section",
            F.col("position").cast("bigint").alias("position"),
            "name",
            "award_count",
            F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("spend"),
        )
    )


def spend_report(
    awards: DataFrame,
    items: DataFrame | None = None,
    region: str | None = None,
    agency: str | None = None,
) -> DataFrame:
    """Spend of some items, of a filter, or of both; the total is zero when neither is given.

    An empty list of items counts as not given, as in a search that found nothing.
    """
    rows = scoped(awards, region, agency)
    if items is not None and not items.isEmpty():
        rows = rows.join(items.select("item_id"), "item_id", "left_semi")
    elif not region and not agency:
        rows = rows.filter(F.lit(False))
    return _nested(_report(_sums(rows), [])).select(F.inline(_or_zero(F.col("report"))))


def sample_awards(awards: DataFrame, pairs: DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """The largest awards of the given items, ``TOP`` per key."""
    ties = [F.asc_nulls_last(c) for c in SAMPLE_COLUMNS if c != "contract_amount"]
    order = [F.desc_nulls_last("contract_amount"), *ties]
    if pairs is None:
        return awards.select(*SAMPLE_COLUMNS).orderBy(*order).limit(TOP)
    wanted = awards.join(pairs.select("item_id"), "item_id", "left_semi").select("item_id", *SAMPLE_COLUMNS)
    if not keys:
        return wanted.drop("item_id").orderBy(*order).limit(TOP)
    # the best of a query are among the best of its items, so each item is cut before the join
    in_item = F.row_number().over(W.partitionBy("item_id").orderBy(*order))
    best = wanted.withColumn("_rn", in_item).filter(F.col("_rn") <= TOP).drop("_rn")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")
    shown = best.join(pairs, "item_id").select(*keys, *SAMPLE_COLUMNS)
    return shown.withColumn("position", place).filter(F.col("position") <= TOP)


def spend_by_query(
    awards: DataFrame,
    queries: DataFrame,
    pool: DataFrame,
    shown: DataFrame,
    region: str | None = None,
    agency: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(report, samples) per query: spend over the pool, samples over the shown items.

    Every query has a total row. One without candidates shows the whole filter's spend and samples if there
    is a filter, zeros otherwise.
    """
    rows = scoped(awards, region, agency)
    wanted = rows.join(pool.select("item_id"), "item_id", "left_semi").select("item_id", *SAMPLE_COLUMNS)
    wanted = stored(wanted, "pool-awards")
    report = _nested(_report(_sums(wanted, "item_id").join(pool, "item_id"), ["query_id"]), "query_id")
    samples = _as_list(sample_awards(wanted, shown, ["query_id"]), SAMPLE_ROW, "samples", "query_id")
    whole_report = whole_samples = None
    # the whole filter is summed only where a query has no candidate
    if (region or agency) and not queries.join(pool, "query_id", "left_anti").isEmpty():
        order = W.orderBy(F.desc("contract_amount"), *[F.asc_nulls_last(c) for c in SAMPLE_COLUMNS])
        largest = sample_awards(rows, None).withColumn("position", F.row_number().over(order).cast("bigint"))
        whole_report = _nested(_report(_sums(rows), []))
        whole_samples = _as_list(largest, SAMPLE_ROW, "samples")
    reports = _per_query(queries, pool, report, whole_report)
    return (
        reports.select("query_id", F.inline(_or_zero(F.col("report")))),
        _per_query(queries, pool, samples, whole_samples).select("query_id", F.inline("samples")),
    )


def _per_query(queries: DataFrame, pool: DataFrame, lists: DataFrame, fallback: DataFrame | None) -> DataFrame:
    """Each query with its list; one without candidates has the fallback's list.

    A list is at most eleven rows, so a query carries it as one value. (A union of per-query frames would do
    too, but Spark 4.1 can lose the partitioning of such a union when it coalesces its sides.)
    """
    listed = queries.select("query_id").join(lists, "query_id", "left")
    if fallback is None:
        return listed
    name = fallback.columns[0]
    found = pool.select("query_id").distinct().withColumn("found", F.lit(True))
    value = F.when(F.col("found").isNull(), fallback.scalar()).otherwise(F.col(name))
    return listed.join(found, "query_id", "left").select("query_id", value.alias(name))


def _as_list(df: DataFrame, columns: Sequence[str], name: str, *keys: str) -> DataFrame:
    """The rows as one array, per key."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))


def _nested(report: DataFrame, *keys: str) -> DataFrame:
    return _as_list(report, REPORT_COLUMNS, "report", *keys)


def _or_zero(report: Column) -> Column:
    """The report, or a single zero total where there is none."""
    zero = F.struct(
        F.lit("total").alias("section"),
        F.lit(1).cast("bigint").alias("position"),
        F.lit(None).cast("string").alias("name"),
        F.lit(0).cast("bigint").alias("award_count"),
        F.lit(0.0).alias("spend"),
    )
    return F.when(F.size(report) > 0, report).otherwise(F.array(zero))


def totals(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The total rows as (total_spend, award_count, avg_spend)."""
    average = F.when(F.col("award_count") > 0, F.col("spend") / F.col("award_count")).otherwise(0.0)
    return report.filter("section = 'total'").select(
        *keys,
        F.col("spend").alias("total_spend"),
        "award_count",
        average.alias("avg_spend"),
    )


def _lines(section: str, text: Column) -> Column:
    """Lines of a section in order of position; a section has at most ``TOP`` rows."""
    listed = F.collect_list(
        F.when(F.col("section") == section, F.struct("position", text.alias("line")))
    )
    return F.array_join(F.transform(F.sort_array(listed), lambda x: x["line"]), "\n")


def summary_text(report: DataFrame, samples: DataFrame, queries: DataFrame, n_samples: int = 3) -> DataFrame:
    """One readable summary per query, made of the numbers alone.

    ``queries`` has (query_id, query_text).
    """
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(": "), peso(F.col("spend")),
        F.lit(" ("), F.format_number("award_count", 0), F.lit(" awards)"),
    )
    numbers = report.groupBy("query_id").agg(
        F.max(F.when(F.col("section") == "total", F.col("spend"))).alias("spend"),
        F.max(F.when(F.col("section") == "total", F.col("award_count"))).alias("award_count"),
        _lines("agency", line).alias("agencies"),
        _lines("region", line).alias("regions"),
    )
    sample_line = F.concat_ws(
        " | ", F.concat(F.lit("- "), peso(F.col("contract_amount"))), "item_name", "agency", "awardee",
        F.col("award_date").cast("string"), "award_ref",
    )
    contracts = (
        samples.filter(F.col("position") <= n_samples)
        .groupBy("query_id")
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("position", sample_line.alias("line")))),
                    lambda x: x["line"],
                ),
                "\n",
            ).alias("contracts")
        )
    )
    none = F.concat(F.lit("No contracts match '"), F.col("query_text"), F.lit("'."))

    def block(title: str, name: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(f"{title}:\n"), F.col(name)))

    found = F.concat_ws(
        "\n",
        F.concat(F.lit("Spend for '"), F.col("query_text"), F.lit("'")),
        F.concat(F.lit("Total: "), peso(F.col("spend")), F.lit(" over "),
                 F.format_number("award_count", 0), F.lit(" contracts")),
        F.concat(F.lit("Mean: "), peso(F.col("spend") / F.col("award_count"))),
        block("Top agencies", "agencies"),
        block("Top regions", "regions"),
        block("Largest contracts", "contracts"),
    )
    return (
        queries.select("query_id", "query_text")
        .join(numbers, "query_id", "left")
        .join(contracts, "query_id", "left")
        .select("query_id", F.when(F.col("award_count") > 0, found).otherwise(none).alias("summary"))
    )


def context_text(summaries: DataFrame, items: DataFrame) -> DataFrame:
    """Each summary followed by the items that were found, best first.

    ``items`` has (query_id, final_rank) and the catalogue columns, a few rows per query.
    """
    line = F.concat(
        F.col("final_rank").cast("string"), F.lit(". "),
        F.concat_ws(" | ", F.substring("item_id", 1, 8), "item_name", "notice_title", "unspsc_desc", "item_desc"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("final_rank", line.alias("line"))))
    found = items.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("found")
    )
    listed = F.concat(F.lit("Matched items:\n"), F.col("found"))
    return (
        summaries.join(found, "query_id", "left")
        .select("query_id", F.concat_ws("\n", "summary", listed).alias("context"))
    )
