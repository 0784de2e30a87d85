import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spendloom.functions import text, values
from tests.conftest import rows


def one(spark, expr, **columns):
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("  Bond   Paper ", "Bond Paper"),
        ("a\t\nb", "a b"),
        (" x ", "x"),
        ("a b", "a b"),
        ("a\x0bb", "a\x0bb"),
        ("\tx", "x"),
        ("NULL", None),
        (" NULL ", None),
        ("NULLS", "NULLS"),
        ("", ""),
        (None, None),
    ],
)
def test_blanks_and_literal_null(spark, raw, clean):
    c = F.col("x")
    assert one(spark, text.clean_text(c), x=raw) == clean
    assert one(spark, text.null_text(text.squash_blanks(c)), x=raw) == clean


def test_item_key_has_no_separator_and_keeps_null(spark):
    key = text.item_key(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, key, a="Ab", b="C", c="Ñd") == hashlib.md5("abcñd".encode()).hexdigest()
    assert one(spark, key, a="A", b="bc", c="Ñd") == one(spark, key, a="AB", b="c", c="ñD")
    assert one(spark, key, a="A", b=None, c="x") is None


def test_contains_ignores_case_and_takes_wildcards(spark):
    assert one(spark, text.contains_ci(F.col("x"), "Health"), x="DEPARTMENT OF HEALTH - MAIN")
    assert one(spark, text.contains_ci(F.col("x"), "dep%main"), x="DEPARTMENT OF HEALTH - MAIN")
    assert not one(spark, text.contains_ci(F.col("x"), "doh"), x="DEPARTMENT OF HEALTH")


def test_search_tokens(spark):
    tokens = text.search_tokens(F.col("x"))
    assert one(spark, tokens, x="The Café of A4 70gsm paper, PAPER") == ["cafe", "gsm", "paper", "paper"]
    assert one(spark, tokens, x="café") == ["cafe"]
    assert one(spark, tokens, x=None) == []
    assert one(spark, text.search_tokens(F.col("x"), ["paper"]), x="the paper") == ["the"]


def test_clean_query(spark):
    assert one(spark, text.clean_query(F.col("x")), x="  a+b (c)! ") == "a b  c"
    assert one(spark, text.clean_query(F.col("x")), x="?!") == ""


def test_item_payload(spark):
    payload = text.item_payload(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, payload, a=" T ", b="N", c="D") == "Title: T | Item: N | Description: D"
    assert one(spark, payload, a="NULL", b="N", c=" ") == "Item: N"
    assert one(spark, payload, a=None, b="", c="NULL") == "procurement item"


def test_table_prefix(spark):
    assert one(spark, text.table_prefix(F.col("x")), x="2025-Q1") == "y2025_q1"


@pytest.mark.parametrize(
    ("serial", "day"),
    [
        ("45678", dt.date(2025, 1, 21)),
        ("45678.4", dt.date(2025, 1, 21)),
        ("45678.5", dt.date(2025, 1, 22)),
        ("NULL", None),
        ("", None),
        (None, None),
    ],
)
def test_serial_date(spark, serial, day):
    assert one(spark, values.serial_date(F.col("x")), x=serial) == day


def test_costs(spark):
    assert one(spark, values.token_estimate(F.col("x")), x=10.0) == 2
    assert one(spark, values.embed_cost(F.col("x")), x=2_000_000.0) == pytest.approx(0.05)
    assert one(spark, values.call_cost(F.col("x"), F.col("y")), x=1e6, y=2e6) == pytest.approx(0.675)


def test_feedback_wording(spark):
    verdict = values.normal_feedback(F.col("x"))
    assert one(spark, verdict, x="Thumbs UP") == "thumbs_up"
    assert one(spark, verdict, x="bad") == "thumbs_down"
    assert one(spark, verdict, x=None) is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    found = [r[0] for r in df.select(values.cosine(F.col("a"), F.col("b"))).collect()]
    assert found[0] == pytest.approx(0.5**0.5)
    assert found[1] is None


def test_first_usable(spark):
    df = spark.createDataFrame([("", "2.5"), ("x", None), ("1", "9")], "a string, b string")
    assert rows(df.select(values.first_usable(F.col("a"), F.col("b")))) == [(2.5,), (None,), (1.0,)]


def test_display_cells(spark):
    from spendloom.operators.analytics import display_rows

    df = spark.sql("select 1 as n, cast(null as string) as s, date '2025-01-02' as d")
    assert rows(display_rows(df)) == [(1, "", "2025-01-02")]


def test_clean_text_is_the_plain_replacement(spark):
    draw, pieces = random.Random(5), ["a", "NULL", "b~!", "é", " ", "  ", "\t", "\n", "\r", "\u00a0", "\u3000", "\x0b", "\x7f"]
    texts = [(k, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 5)))) for k in range(3000)]
    frame = spark.createDataFrame([*texts, (-1, None), (-2, "word " * 20_000 + "end"), (-3, "a \u2028"), (-4, "a b\u2028")], "k int, x string")
    plain = text.null_text(text.squash_blanks(F.col("x")))
    assert frame.filter(~text.clean_text(F.col("x")).eqNullSafe(plain)).collect() == []
