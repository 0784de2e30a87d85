import pytest
from pyspark.sql import functions as F

from spendloom.operators import catalogue, quality, silver
from spendloom.plans.medallion import Lake, load_quarters
from spendloom.sources.tables import append_new, table_exists
from tests.award_rows import bronze
from tests.conftest import rows


def typed(spark, *changes):
    return silver.type_and_clean(bronze(spark, *changes))


def test_items_ignore_case_and_skip_missing_text(spark):
    awards = typed(spark, {}, {"item_name": "BOND PAPER"}, {"item_desc": "NULL"}, {"item_name": "Pens"})
    items = catalogue.unique_items(awards)
    assert items.count() == 2
    assert {r["item_name"] for r in items.collect()} == {"BOND PAPER", "Pens"}
    assert rows(catalogue.keyless_awards(awards)) == [(4, 1)]


def test_catalogue_grows_by_new_items_only(spark, tmp_path):
    path = str(tmp_path / "items")
    append_new(catalogue.unique_items(typed(spark, {})), path, "item_id")
    append_new(catalogue.unique_items(typed(spark, {}, {"item_name": "Pens"})), path, "item_id")
    append_new(catalogue.unique_items(typed(spark, {"item_name": "Pens"})), path, "item_id")
    assert sorted(r["item_name"] for r in spark.read.parquet(path).collect()) == ["Bond Paper", "Pens"]


def test_largest_award_per_item(spark):
    awards = catalogue.with_item_id(
        typed(spark, {"contract_amount": "5"}, {"contract_amount": "9", "award_ref": "7"}, {"item_name": "Pens"})
    )
    assert sorted(r["award_ref"] for r in catalogue.largest_award_per_item(awards).collect()) == ["1", "7"]


def test_load_is_repeatable_and_quarters_are_kept_apart(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = bronze(spark, {}, {}, {"contract_amount": "NULL"}, {"contract_amount": "0", "award_ref": "9"})
    second = bronze(spark, {"quarter": "2025-Q2", "item_name": "Pens", "extra": "x"})
    for frame in (first, second, first):
        assert load_quarters(lake, frame)
    assert lake.read("all_awards").count() == 2
    assert lake.read("awards_deduped", ["2025-Q1"]).count() == 2
    assert lake.read("quarantine_no_award").count() == 1
    assert lake.read("unique_items").count() == 2


def test_failed_gate_leaves_catalogue_and_gold_alone(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    with pytest.raises(quality.QualityGateError):
        load_quarters(lake, bronze(spark, {"line_item_no": "-1"}))
    assert not (tmp_path / "unique_items").exists()
    assert not (tmp_path / "all_awards").exists()


def test_rerun_with_fewer_rows_leaves_nothing_stale(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert load_quarters(lake, bronze(spark, {}, {"contract_amount": "NULL"}, {"contract_amount": "0", "award_ref": "9"}))
    assert load_quarters(lake, bronze(spark, {"quarter": "2025-Q2"}))
    assert (lake.read("quarantine_no_award").count(), lake.read("awards_zero_amount").count()) == (1, 1)
    assert load_quarters(lake, bronze(spark, {}))
    assert not table_exists(spark, lake.path("quarantine_no_award"))
    assert not table_exists(spark, lake.path("awards_zero_amount"))
    assert lake.read("all_awards").count() == 2
    assert load_quarters(lake, bronze(spark, {"quarter": "2025-Q2"}), quarters=["2025-Q1", "2025-Q2"])
    assert [r["quarter"] for r in lake.read("all_awards").collect()] == ["2025-Q2"]


def test_columns_of_some_quarters_are_kept(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    load_quarters(lake, bronze(spark, {}))
    load_quarters(lake, bronze(spark, {"quarter": "2025-Q2", "award_ref": "8"}).withColumn("extra", F.lit("x")))
    found = lake.read("all_awards").select("quarter", "extra").collect()
    assert sorted(map(tuple, found)) == [("2025-Q1", None), ("2025-Q2", "x")]


def test_gate_reads_the_stored_embeddings(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    spark.createDataFrame([("a", 1)], "item_id string, other int").write.parquet(lake.path("item_embeddings"))
    with pytest.raises(quality.QualityGateError, match="embedding column present"):
        load_quarters(lake, bronze(spark, {}))
