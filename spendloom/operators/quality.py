"""Data-quality gate: row conservation, types, sentinels, white space, catalogue keys.

Each input is scanned once, the typed awards once per kind of check, reading its columns only. The scans give small
(metric, value) rows that a single-row aggregate lines up, and the checks are expressions over that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.text import EDGE_BLANKS
from spendloom.schema import BUDGET_SENTINEL, DATE_COLUMNS, LITERAL_NULL

# Which columns the sentinel and white-space checks look at, and the earliest sane year.
SENTINEL_COLUMNS = (
    "agency", "notice_title", "item_name", "item_desc", "award_title", "awardee", "unspsc_code", "unspsc_desc",
)
BLANK_CHECKED = ("agency", "notice_title", "item_name", "awardee")
EARLIEST_YEAR = 2000


class QualityGateError(ValueError):
    """At least one check failed."""


def _count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _has_blanks(c: Column) -> Column:
    """Whether ``strip_blanks`` or the collapse of two blanks would change the text."""
    return c.rlike(EDGE_BLANKS) | c.contains("  ")


def _typed_metrics() -> list[dict[str, Column]]:
    """The metrics of typed awards by kind. Each kind is a scan of its own, since the code that Spark generates for all of
    them at once, typing included, is larger than the JVM compiles and then runs interpreted."""
    numbers = {
        "typed": F.count(F.lit(1)),
        "bad_amount": _count_if(F.col("contract_amount").isNull() | (F.col("contract_amount") <= 0)),
        "bad_line": _count_if(F.col("line_item_no").isNull() | (F.col("line_item_no") <= 0)),
        "budget_sentinel": _count_if(F.col("item_budget") == BUDGET_SENTINEL),
    }
    dates = {f"date_{c}": _count_if(F.year(c) < EARLIEST_YEAR) for c in DATE_COLUMNS}
    literal = F.lit(False)
    for c in SENTINEL_COLUMNS:
        literal = literal | F.coalesce(F.col(c) == LITERAL_NULL, F.lit(False))
    blanks = {f"blanks_{c}": _count_if(_has_blanks(F.col(c))) for c in BLANK_CHECKED}
    return [numbers, dates, {"literal_null": F.count_if(literal)}, blanks]


def _long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    row = df.agg(*[expr.cast("bigint").alias(name) for name, expr in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])
    return row.select(F.inline(pairs))


def quality_checks(
    *,
    typed: DataFrame,
    bronze: DataFrame | None = None,
    awards_raw: DataFrame | None = None,
    quarantine: DataFrame | None = None,
    deduped: DataFrame | None = None,
    zero_amount: DataFrame | None = None,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """Check rows (name, category, expected, actual, passed, detail); a table not given counts as empty."""
    kinds = _typed_metrics()
    rows = reduce(DataFrame.unionByName, [_long(typed, metrics) for metrics in kinds])
    for name, frame in {
        "bronze": bronze,
        "awards_raw": awards_raw,
        "quarantine": quarantine,
        "deduped": deduped,
        "zero_amount": zero_amount,
    }.items():
        if frame is not None:
            rows = rows.unionByName(_long(frame, {name: F.count(F.lit(1))}))
    if catalogue is not None:
        # keys are counted in two steps so that no task holds the set of all keys
        per_key = catalogue.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(
            _long(
                per_key,
                {"items": F.coalesce(F.sum("n"), F.lit(0)), "item_keys": F.count("item_id")},
            )
        )

    def value(metric: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0))

    names = [
        "bronze", "awards_raw", "quarantine", "deduped", "zero_amount", "items", "item_keys",
        *(name for metrics in kinds for name in metrics),
    ]
    line = rows.agg(*[value(n).alias(n) for n in names])

    def check(name: str, category: str, expected: Column, actual: Column, detail: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(category).alias("category"),
            expected.cast("bigint").alias("expected"),
            actual.cast("bigint").alias("actual"),
            (expected == actual).alias("passed"),
            F.lit(detail).alias("detail"),
        )

    zero = F.lit(0)
    checks = [
        check("grain split keeps every row", "row conservation", F.col("bronze"),
              F.col("awards_raw") + F.col("quarantine"), "bronze = awards + quarantine"),
        check("typing keeps every row", "row conservation", F.col("deduped"),
              F.col("typed") + F.col("zero_amount"), "deduped = typed + zero amount"),
        check("contract_amount positive", "types", zero, F.col("bad_amount"), "rows NULL or <= 0"),
        check("line_item_no positive", "types", zero, F.col("bad_line"), "rows NULL or <= 0"),
        *[check(f"{c} plausible", "types", zero, F.col(f"date_{c}"), f"rows before {EARLIEST_YEAR}")
          for c in DATE_COLUMNS],
        check("item_budget sentinel gone", "sentinels", zero, F.col("budget_sentinel"), "rows still -1"),
        check("no literal NULL text", "sentinels", zero, F.col("literal_null"), "rows with the text NULL"),
        *[check(f"{c} blanks clean", "white space", zero, F.col(f"blanks_{c}"), "rows with stray blanks")
          for c in BLANK_CHECKED],
    ]
    if catalogue is not None:
        has_vector = F.lit(int("embedding" in catalogue.columns))
        checks += [
            check("catalogue not empty", "catalogue", F.lit(1), (F.col("items") > 0).cast("int"), "items > 0"),
            check("embedding column present", "catalogue", F.lit(1), has_vector, "schema has the column"),
        ]
        distinct = check(
            "item_id distinct", "catalogue", F.col("items"), F.col("item_keys"), "items = distinct keys"
        )
        listed = F.when(F.col("items") > 0, F.array(*checks, distinct)).otherwise(F.array(*checks))
    else:
        listed = F.array(*checks)
    return line.select(F.inline(listed))


def gate_summary(checks: DataFrame) -> DataFrame:
    """Passed and total counts, and the names of the failed checks."""
    return checks.agg(
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))), ", "
        ).alias("failed"),
    )


def run_quality_gate(checks: DataFrame, strict: bool = True) -> bool:
    """The verdict; strict raises so that a pipeline stops here. Only the summary row reaches the driver."""
    verdict = gate_summary(checks).first()
    good = verdict["passed"] == verdict["total"]
    if strict and not good:
        raise QualityGateError(f"{verdict['total'] - verdict['passed']} checks failed: {verdict['failed']}")
    return good
