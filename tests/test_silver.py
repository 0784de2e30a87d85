import datetime as dt
from decimal import Decimal

import pytest

from spendloom.operators import silver
from spendloom.plans import testbed
from tests.award_rows import bronze
from tests.conftest import rows


def test_grain_split_halves_are_complements(spark):
    raw = bronze(spark, {}, {"contract_amount": "NULL"}, {"contract_amount": None}, {"contract_amount": "0"})
    awards, parked = silver.split_by_grain(raw)
    assert (awards.count(), parked.count()) == (2, 2)
    assert rows(silver.grain_counts(raw)) == [(2, 2, 4)]


def test_exact_copies_go_and_near_copies_stay(spark):
    raw = bronze(spark, {}, {}, {"award_ref": "2"}, {"region": None}, {"region": None})
    assert silver.deduplicate(raw).count() == 3


def test_rows_of_one_hash_are_compared_in_full(spark):
    # Nulls don't enter a row's hash, so these rows share one.
    frame = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("b", "c")], "x string, y string")
    assert rows(silver.deduplicate(frame), "x", "y") == [(None, "a"), ("a", None), ("b", "c")]
    nothing = silver.deduplicate(frame.limit(0))
    assert nothing.columns == ["x", "y"] and nothing.count() == 0


def test_typing(spark):
    raw = bronze(
        spark,
        {
            "item_budget": "-1",
            "contract_duration": "0",
            "award_date": "45630.5",
            "closing_date": "NULL",
            "notice_title": " A  b ",
            "item_desc": "NULL",
            "region": "NULL",
            "later_column": "NULL",
        },
    )
    typed = silver.type_and_clean(raw)
    row = typed.first()
    assert dict(typed.dtypes)["contract_amount"] == "decimal(15,2)"
    assert row["contract_amount"] == Decimal("100.00")
    assert row["item_budget"] is None
    assert row["contract_duration"] is None
    assert row["award_date"] == dt.date(2024, 12, 5)
    assert row["closing_date"] is None
    assert row["notice_title"] == "A b"
    assert row["item_desc"] is None
    assert row["region"] is None
    assert row["later_column"] is None


def test_zero_and_unreadable_amounts(spark):
    raw = bronze(spark, {}, {"contract_amount": "0.00"}, {"contract_amount": "-5"}, {"contract_amount": "n/a"})
    stage = silver.refine(raw)
    assert stage.typed.count() == 2
    assert stage.zero_amount.count() == 1


def test_strict_typing_fails_and_permissive_counts(spark):
    raw = bronze(spark, {}, {"approved_budget": "1,234.50"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        silver.type_and_clean(raw).collect()
    assert {r["approved_budget"] for r in silver.type_and_clean(raw, strict=False).collect()} == {Decimal("120.00"), None}
    assert silver.rejected_cells(raw).first()["approved_budget"] == 1


@pytest.mark.parametrize("words", [1, 1 << 21])
def test_only_marked_rows_move_whole(spark, monkeypatch, words):
    monkeypatch.setattr(silver, "MARK_WORDS", words)
    frame = spark.range(600).selectExpr("cast(if(id % 7 = 0, 7, id) as string) as x", "if(id % 2 = 0, null, 'b') as y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = silver.deduplicate(frame)
        assert rows(found, "x", "y") == rows(frame.distinct(), "x", "y")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wide_part_texts_are_joined_last(spark, sf_dir):
    plan = testbed.lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "p_partkey" in joins[0] and "o_orderkey" in joins[1]
