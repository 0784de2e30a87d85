"""Read-only audit of SQL texts, and ad-hoc SQL over the awards.

The audit is a job over any table of statements, such as the query log: word checks as column expressions.
It looks at words, it does not parse SQL.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.operators.analytics import ROW_CAP, display_rows
from spendloom.schema import to_headings

# Words that a read-only statement may not contain.
FORBIDDEN_WORDS = (
    "ALTER", "ATTACH", "COPY", "CREATE", "DELETE", "DETACH", "DROP", "EXEC", "EXECUTE", "EXPORT", "GRANT",
    "INSERT", "INSTALL", "LOAD", "PRAGMA", "REPLACE", "REVOKE", "TRUNCATE", "UPDATE",
)
# Spark's own ways out of a read: functions that call the JVM, and statements that name tables.
ENGINE_WORDS = ("IDENTIFIER", "JAVA_METHOD", "REFLECT", "TABLE", "TRY_REFLECT")
AWARDS_VIEW = "all_awards"
# A fixed value: what LIKE on the award date looks like.
DATE_LIKE = r'(?i)("Award Date"|\bAward Date\b)\s+LIKE'
_STRING = r"'(?:[^']|'')*'"
_NAME = r'(?:"[^"]*"|`[^`]*`|[^\s(),;"`]+)'


class RefusedStatementError(ValueError):
    """The statement is not a plain read."""


def audit_statements(df: DataFrame, column: str = "sql") -> DataFrame:
    """Add (allowed, reason, safe_sql) to each statement.

    Besides the forbidden words, a statement may not hold comments, call the JVM, join by comma, or read anything but
    the awards and its own WITH queries; text in quotes is no part of the statement for this.

    ``safe_sql`` is the statement without its closing semicolon, with LIKE on the award date made a text
    comparison, and with a row cap where it has no LIMIT of its own. It is NULL for refused statements.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""), r";+$", "")
    words = F.filter(F.split(F.upper(text), r"[\s(),]+"), lambda w: w != "")
    forbidden = F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in FORBIDDEN_WORDS])))

    # The statement without its strings, and without the FROM of EXTRACT and its like.
    bare = F.regexp_replace(text, _STRING, "''")
    plain = F.regexp_replace(bare, r"(?i)\b(EXTRACT|TRIM|SUBSTRING|OVERLAY|POSITION)\s*\([^()]*?\bFROM\b", "$1(")
    inner = F.transform(
        F.regexp_extract_all(plain, F.lit(rf"(?i)(?:\bWITH|\bRECURSIVE|,)\s*({_NAME})\s*(?:\([^()]*\)\s*)?AS\s*\("), 1), _bare_name
    )
    sources = F.transform(F.regexp_extract_all(plain, F.lit(rf"(?i)\b(?:FROM|JOIN)\s+(?:LATERAL\s+)?((?:{_NAME}\.?)+)"), 1), _bare_name)
    known = F.concat(F.array(F.lit(AWARDS_VIEW), F.lit(f"gold.{AWARDS_VIEW}")), inner)
    foreign = F.array_except(sources, known)
    comma = F.regexp_like(plain, F.lit(rf"(?i)\b(?:FROM|JOIN)\s+{_NAME}(?:\s+(?:AS\s+)?(?!(?:WHERE|GROUP|ORDER|ON|USING)\b)\w+)?\s*,"))
    engine = F.array_intersect(F.split(F.upper(plain), r"[^A-Z_0-9]+"), F.array(*[F.lit(w) for w in ENGINE_WORDS]))

    def first_of(reason: Column, *more: tuple[Column, Column]) -> Column:
        for condition, message in more:
            reason = reason.when(condition, message)
        return reason

    reason = first_of(
        F.when(F.contains("_text", F.lit(";")), F.lit("several statements")),
        (F.size("_words") == 0, F.lit("empty statement")),
        (~F.get("_words", F.lit(0)).isin("SELECT", "WITH"),
         F.concat(F.lit("statement type "), F.get("_words", F.lit(0)))),
        (F.size("_forbidden") > 0, F.concat(F.lit("forbidden word "), F.array_join("_forbidden", ", "))),
        (F.regexp_like("_bare", F.lit(r"--|/\*")), F.lit("comment")),
        (F.size("_engine") > 0, F.concat(F.lit("forbidden word "), F.array_join(F.array_sort("_engine"), ", "))),
        (F.size("_foreign") > 0, F.concat(F.lit("foreign table "), F.array_join(F.array_sort("_foreign"), ", "))),
        (F.col("_comma") | F.regexp_like("_bare", F.lit(r"\w\s*\.\s*`[^`]*/")), F.lit("foreign table")),
    )
    dated = F.regexp_replace(
        "_text", F.lit(DATE_LIKE), F.lit('CAST("Award Date" AS STRING) LIKE')
    )
    capped = F.when(F.array_contains("_words", "LIMIT"), dated).otherwise(
        F.concat(dated, F.lit(f" LIMIT {ROW_CAP}"))
    )
    return (
        df.withColumns({
            "_text": text, "_words": words, "_forbidden": forbidden, "_bare": bare, "_engine": engine, "_foreign": foreign, "_comma": comma
        })
        .withColumn("reason", F.coalesce(reason, F.lit("")))
        .withColumn("allowed", F.col("reason") == "")
        .withColumn("safe_sql", F.when(F.col("allowed"), capped))
        .drop("_text", "_words", "_forbidden", "_bare", "_engine", "_foreign", "_comma")
    )


def _bare_name(name: Column) -> Column:
    """A name without its quotes and in lower case."""
    return F.lower(F.regexp_replace(name, r'["`]', ""))


def _for_spark(statement: str, view: str) -> str:
    """The statement with Spark's quotes and the view's name, strings left as they are."""

    def outside(text: str) -> str:
        text = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", text)
        return re.sub(rf"(?i)(?<![\w.])`?(?:gold`?\s*\.\s*`?)?{AWARDS_VIEW}`?(?!\w)", f"`{view}`", text)

    parts = re.split(f"({_STRING})", statement)
    return "".join(p if k % 2 else outside(p) for k, p in enumerate(parts))


def run_sql(awards: DataFrame, statement: str, args: dict | None = None, display: bool = False) -> DataFrame:
    """A read-only statement over the awards under their published headings, with named parameters.

    Double quotes name columns, as users write them; a ``gold.`` before the view name is accepted. Refused
    statements raise. The result holds at most the statement's own LIMIT, or ``ROW_CAP`` rows. Each call has a view
    of its own and leaves no option behind.
    """
    spark = awards.sparkSession
    verdict = audit_statements(spark.createDataFrame([(statement,)], "sql string")).first()
    if not verdict["allowed"]:
        raise RefusedStatementError(verdict["reason"])
    view = f"{AWARDS_VIEW}_{uuid.uuid4().hex}"
    to_headings(awards).createOrReplaceTempView(view)
    try:
        result = spark.sql(_for_spark(verdict["safe_sql"], view), args=args or {})
    finally:
        spark.catalog.dropTempView(view)
    return display_rows(result) if display else result


class SqlAnswer(NamedTuple):
    """What a statement gave: rows, or the reason why there are none."""

    success: bool
    rows: DataFrame | None
    error: str


def try_sql(awards: DataFrame, statement: str, args: dict | None = None, display: bool = False) -> SqlAnswer:
    """``run_sql`` with refusals and unknown names as an answer instead of an exception."""
    try:
        return SqlAnswer(True, run_sql(awards, statement, args, display), "")
    except (RefusedStatementError, AnalysisException, ParseException) as error:
        return SqlAnswer(False, None, str(error))
