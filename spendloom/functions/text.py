"""Text expressions: cleaning, keys, search tokens, payloads."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.schema import LITERAL_NULL

# English function words left out of the search index by default. Callers may pass their
# own list, for instance pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english").
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this",
    "to", "was", "will", "with",
)


def english_stop_words() -> tuple[str, ...]:
    """Spark's longer list of English function words, apostrophes cut as the tokens have them."""
    from pyspark.ml.feature import StopWordsRemover

    listed = StopWordsRemover.loadDefaultStopWords("english")
    return tuple(sorted({part for word in listed for part in word.split("'")} - {""}))


EDGE_BLANKS = r"^\p{Zs}+|\p{Zs}+$"


def strip_blanks(c: Column) -> Column:
    """Trim every Unicode space separator, not only U+0020."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def squash_blanks(c: Column) -> Column:
    """Collapse runs of ASCII white space to one blank, then trim."""
    return strip_blanks(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))


def null_text(c: Column) -> Column:
    """The literal text NULL becomes a real NULL."""
    return F.nullif(c, F.lit(LITERAL_NULL))


def clean_text(c: Column) -> Column:
    """``null_text(squash_blanks(c))``, for a plain column.

    Nearly all values are clean already. They cost one containment test and one search, which stops after one pass over
    printable ASCII words with single blanks between them; the replacements run on the others. The value is named in
    each branch, so the branches stay cheap where a filter repeats them.
    """
    blank = r"[\p{Zs}\t\n\f\r]"
    only_null = c.contains(LITERAL_NULL) & c.rlike(f"^{blank}*{LITERAL_NULL}{blank}*$")
    untidy = c.rlike(r"^(?![!-~]++(?: [!-~]++)*+\z)(?s:.*?)(?:[\t\n\f\r]|  |^\p{Zs}|\p{Zs}$)")
    return F.when(only_null, F.lit(None)).when(untidy, squash_blanks(c)).otherwise(c)


def item_key(title: Column, name: Column, desc: Column) -> Column:
    """Content key of an item; NULL as soon as one part is NULL."""
    return F.md5(F.lower(F.concat(title, name, desc)))


def contains_ci(c: Column, text: str) -> Column:
    """Case-insensitive containment; % and _ in the text act as wildcards."""
    return F.lower(c).like(f"%{text}%".lower())


def clean_query(c: Column) -> Column:
    """Everything but letters, digits and white space becomes a blank."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " "))


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical decomposition starts with a-z, and that base letter."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and "a" <= base[0] <= "z":
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def search_tokens(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case, strip accents, split on anything outside a-z, drop stop words; NULL text gives no token."""
    accented, plain = _accent_map()
    lowered = F.lower(F.coalesce(c, F.lit("")))
    unaccented = F.regexp_replace(F.translate(lowered, accented, plain), "[\\u0300-\\u036f]", "")
    # letter-by-letter translation only where the text has something to translate
    folded = F.when(lowered.rlike(r"[^\x00-\x7f]"), unaccented).otherwise(lowered)
    left_out = ["", *stop_words]
    # array_except would also remove repeats, which term frequencies need
    return F.filter(F.split(folded, "[^a-z]+"), lambda t: ~t.isin(left_out))


def _labelled(label: str, c: Column) -> Column:
    text = F.trim(c)
    return F.when((text != "") & (text != LITERAL_NULL), F.concat(F.lit(f"{label}: "), text))


def item_payload(title: Column, name: Column, desc: Column) -> Column:
    """The labelled text that is embedded for an item."""
    joined = F.concat_ws(
        " | ", _labelled("Title", title), _labelled("Item", name), _labelled("Description", desc)
    )
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("procurement item"))


def blank_if_missing(c: Column) -> Column:
    """Trimmed text, empty where the value is NULL or the literal NULL."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == LITERAL_NULL, "").otherwise(text)


def table_prefix(quarter: Column) -> Column:
    """Identifier-safe form of a quarter label: 2025-Q1 gives y2025_q1."""
    return F.concat(F.lit("y"), F.replace(F.lower(quarter), F.lit("-"), F.lit("_")))


def peso(c: Column) -> Column:
    """An amount with thousands separators and two decimals."""
    return F.concat(F.lit("₱"), F.format_number(c.cast("double"), 2))


def as_display(c: Column, numeric: bool) -> Column:
    """Result cell for display: numbers stay numbers, everything else is text and NULL is empty."""
    return c if numeric else F.coalesce(c.cast("string"), F.lit(""))
