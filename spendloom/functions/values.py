"""Numeric, date and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published prices (USD per million tokens), the character heuristic and the exchange rate.
EMBED_USD_PER_MTOK = 0.025
PROMPT_USD_PER_MTOK = 0.075
COMPLETION_USD_PER_MTOK = 0.30
CHARS_PER_TOKEN = 4
PHP_PER_USD = 56.0

# Day zero of spreadsheet serial numbers.
SERIAL_EPOCH = "1899-12-30"


def serial_date(c: Column) -> Column:
    """Spreadsheet serial text to DATE: a time fraction rounds half up, unusable text gives NULL."""
    days = F.round(c.try_cast("decimal(20,6)"), 0).try_cast("int")
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), days)


def money(c: Column, strict: bool = True) -> Column:
    return c.cast("decimal(15,2)") if strict else c.try_cast("decimal(15,2)")


def token_estimate(chars: Column) -> Column:
    """Tokens for a number of characters."""
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def embed_cost(tokens: Column) -> Column:
    return tokens / F.lit(1_000_000.0) * F.lit(EMBED_USD_PER_MTOK)


def call_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """USD of one model call, or of many when given token sums."""
    return (
        prompt_tokens * F.lit(PROMPT_USD_PER_MTOK) + completion_tokens * F.lit(COMPLETION_USD_PER_MTOK)
    ) / F.lit(1_000_000.0)


def normal_feedback(c: Column) -> Column:
    """Any wording with "up" is a thumbs up, every other wording a thumbs down."""
    return F.when(F.lower(c).contains("up"), "thumbs_up").when(c.isNotNull(), "thumbs_down")


def first_usable(*candidates: Column) -> Column:
    """First candidate that reads as a number."""
    return F.coalesce(*[c.cast("string").try_cast("double") for c in candidates])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays in double precision; NULL when one has no length."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
