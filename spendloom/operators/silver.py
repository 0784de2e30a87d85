"""From all-text bronze to typed awards: grain split, de-duplication, typing and cleaning."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.text import clean_text, null_text
from spendloom.functions.values import money, serial_date
from spendloom.schema import (
    BLANK_CLEANED,
    BUDGET_SENTINEL,
    DATE_COLUMNS,
    DURATION_SENTINEL,
    LITERAL_NULL,
)
from spendloom.sources.tables import text_columns

# Words of the set that marks the hashes of repeated rows.
MARK_WORDS = 1 << 21


class Silver(NamedTuple):
    awards_raw: DataFrame
    quarantine: DataFrame
    deduped: DataFrame
    typed: DataFrame
    zero_amount: DataFrame


def has_award() -> Column:
    """True for rows that reached an award; never NULL, so the two halves are exact complements."""
    return F.coalesce(F.col("contract_amount") != LITERAL_NULL, F.lit(False))


def split_by_grain(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an award amount, rows without one)."""
    return bronze.filter(has_award()), bronze.filter(~has_award())


def grain_counts(bronze: DataFrame) -> DataFrame:
    """Awards, quarantined and original row counts in one pass."""
    return bronze.agg(
        F.count_if(has_award()).alias("awards"),
        F.count_if(~has_award()).alias("quarantine"),
        F.count(F.lit(1)).alias("original"),
    )


def deduplicate(awards_raw: DataFrame) -> DataFrame:
    """Drop exact copies of whole rows.

    Hashes of rows are counted first, so that only eight bytes of a row move. Hashes that occur more than once are
    marked in a broadcast set of at most ``64 * MARK_WORDS`` bits; only rows that it may hold are compared in full, all
    others stay where they are.
    """
    columns = [F.col(f"`{c}`") for c in awards_raw.columns]
    hashed = awards_raw.withColumn("_hash", F.xxhash64(*columns))
    word = F.col("_hash").bitwiseAND(F.lit(MARK_WORDS - 1).cast("bigint"))
    place = F.shiftrightunsigned("_hash", 58).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marks = again.select(word.alias("_word"), mark.alias("_mark")).groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    held = hashed.withColumns({"_word": word, "_mark": mark}).join(F.broadcast(marks), "_word", "left")
    repeated = F.coalesce(F.col("_marks").bitwiseAND(F.col("_mark")) != 0, F.lit(False))
    return held.filter(~repeated).select(*columns).unionByName(held.filter(repeated).select(*columns).distinct())


def _amount() -> Column:
    return F.col("contract_amount").try_cast("double")


def _cleaned(df: DataFrame, strict: bool) -> dict[str, Column]:
    c = F.col
    number = (lambda x, t: x.cast(t)) if strict else (lambda x, t: x.try_cast(t))
    typed = {
        "contract_amount": money(c("contract_amount"), strict),
        "approved_budget": money(c("approved_budget"), strict),
        "item_budget": F.when(
            c("item_budget").try_cast("double") == BUDGET_SENTINEL, F.lit(None)
        ).otherwise(money(c("item_budget"), strict)),
        "quantity": number(c("quantity"), "double"),
        "line_item_no": number(c("line_item_no"), "int"),
        "contract_duration": F.when(
            c("contract_duration") == DURATION_SENTINEL, F.lit(None)
        ).otherwise(c("contract_duration").try_cast("int")),
        **{name: serial_date(c(name)) for name in DATE_COLUMNS},
    }
    for name in text_columns(df):
        if name in typed:
            continue
        typed[name] = clean_text(c(name)) if name in BLANK_CLEANED else null_text(c(f"`{name}`"))
    return {name: typed[name] for name in df.columns if name in typed}


def type_and_clean(deduped: DataFrame, strict: bool = True) -> DataFrame:
    """Typed, cleaned awards with a non-zero amount.

    Strict typing fails on money text that is no number. With ``strict=False`` such a cell becomes NULL;
    ``rejected_cells`` counts them.
    """
    kept = deduped.filter(_amount() != 0)
    return kept.withColumns(_cleaned(kept, strict))


def zero_amounts(deduped: DataFrame) -> DataFrame:
    return deduped.filter(_amount() == 0)


def rejected_cells(deduped: DataFrame) -> DataFrame:
    """Cells that permissive typing turns into NULL, counted per column."""
    kept = deduped.filter(_amount() != 0)
    checks = {
        "contract_amount": "decimal(15,2)",
        "approved_budget": "decimal(15,2)",
        "item_budget": "decimal(15,2)",
        "quantity": "double",
        "line_item_no": "int",
    }
    return kept.agg(
        *[
            F.count_if(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()).alias(name)
            for name, kind in checks.items()
        ]
    )


def refine(bronze: DataFrame, strict: bool = True) -> Silver:
    """The whole silver stage as lazy frames."""
    awards_raw, quarantine = split_by_grain(bronze)
    # Copies are equal in their amount too, so rows are told apart by it first: the rows that count copies and those
    # that are kept then come from the same joins, which Spark runs once.
    typed = type_and_clean(deduplicate(awards_raw.filter(_amount() != 0)), strict)
    zero = deduplicate(zero_amounts(awards_raw))
    return Silver(awards_raw, quarantine, deduplicate(awards_raw), typed, zero)
