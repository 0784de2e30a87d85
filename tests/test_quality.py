import re

import pytest
from pyspark.sql import functions as F

from spendloom.functions.text import strip_blanks
from spendloom.operators import catalogue, quality, silver, sketches
from tests.award_rows import bronze
from tests.conftest import rows


def checks(spark, raw, **replaced):
    stage = silver.refine(raw)
    frames = {
        "typed": stage.typed,
        "bronze": raw,
        "awards_raw": stage.awards_raw,
        "quarantine": stage.quarantine,
        "deduped": stage.deduped,
        "zero_amount": stage.zero_amount,
        "catalogue": catalogue.unique_items(stage.typed).withColumn("embedding", F.lit(None).cast("array<float>")),
    }
    return quality.quality_checks(**{**frames, **replaced})


def failed(frame):
    return sorted(r["name"] for r in frame.collect() if not r["passed"])


def test_clean_rows_pass_all_twenty(spark):
    found = checks(spark, bronze(spark, {}, {"award_ref": "2"}, {"contract_amount": "NULL"}))
    assert found.count() == 20
    assert failed(found) == []
    assert rows(quality.gate_summary(found)) == [(20, 20, "")]
    assert quality.run_quality_gate(found)


@pytest.mark.parametrize(
    ("change", "check"),
    [
        ({"contract_amount": "-3"}, "contract_amount positive"),
        ({"line_item_no": "0"}, "line_item_no positive"),
        ({"line_item_no": None}, "line_item_no positive"),
        ({"award_date": "100"}, "award_date plausible"),
        ({"end_date": "30000"}, "end_date plausible"),
        ({"contract_amount": "abc"}, "typing keeps every row"),
    ],
)
def test_one_defect_fails_one_check(spark, change, check):
    assert failed(checks(spark, bronze(spark, {}, change))) == [check]


@pytest.mark.parametrize(
    ("column", "value", "check"),
    [
        ("item_budget", "-1", "item_budget sentinel gone"),
        ("unspsc_code", "NULL", "no literal NULL text"),
        ("agency", "A  B", "agency blanks clean"),
        ("awardee", " ACME", "awardee blanks clean"),
        ("item_name", "x ", "item_name blanks clean"),
    ],
)
def test_defects_that_cleaning_would_remove(spark, column, value, check):
    raw = bronze(spark, {})
    stage = silver.refine(raw)
    kind = dict(stage.typed.dtypes)[column]
    assert failed(checks(spark, raw, typed=stage.typed.withColumn(column, F.lit(value).cast(kind)))) == [check]


def test_lost_rows_and_missing_tables(spark):
    raw = bronze(spark, {}, {"award_ref": "2"}, {"contract_amount": "NULL"})
    assert failed(checks(spark, raw, quarantine=None)) == ["grain split keeps every row"]
    assert failed(checks(spark, raw, zero_amount=raw.limit(1))) == ["typing keeps every row"]


def test_catalogue_checks(spark):
    raw = bronze(spark, {})
    items = catalogue.unique_items(silver.refine(raw).typed)
    assert failed(checks(spark, raw, catalogue=items)) == ["embedding column present"]
    with_vector = items.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert failed(checks(spark, raw, catalogue=with_vector.union(with_vector))) == ["item_id distinct"]
    empty = checks(spark, raw, catalogue=with_vector.limit(0))
    assert empty.count() == 19
    assert failed(empty) == ["catalogue not empty"]


def test_strict_gate_raises(spark):
    bad = checks(spark, bronze(spark, {"line_item_no": "0"}))
    with pytest.raises(quality.QualityGateError, match="line_item_no positive"):
        quality.run_quality_gate(bad)
    assert not quality.run_quality_gate(bad, strict=False)


def test_stored_sketches_are_as_close_as_their_bound(spark):
    frame = spark.range(60_000).selectExpr("concat('k', id % 25000) as k", "cast(id % 7 as string) as g", "id % 2 as h").unionByName(
        spark.createDataFrame([(None, "0", 0)], "k string, g string, h long")
    )
    stored_ones = sketches.key_sketches(frame, "k", ["g", "h"])
    for by in (["g"], ["h"], ["g", "h"]):
        exact = frame.groupBy(*by).agg(F.count_distinct("k").alias("exact"))
        found = sketches.checked_estimates(stored_ones, exact, by).collect()
        assert len(found) == exact.count() and all(r["within"] for r in found)
    whole = sketches.merged(stored_ones).select(sketches.estimate().alias("n")).first()["n"]
    assert abs(whole - 25_000) <= 25_000 * sketches.relative_bound() and sketches.relative_bound() < 0.05


def test_generated_code_of_the_metrics_is_small_enough_to_compile(spark, tmp_path, capsys):
    """The JVM interprets methods of more than 8,000 bytes."""
    silver.refine(bronze(spark, {})).deduped.write.parquet(f"{tmp_path}/deduped")
    typed = silver.type_and_clean(spark.read.parquet(f"{tmp_path}/deduped"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        quality.quality_checks(typed=typed).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_blanks_at_the_edges_and_inside_are_seen(spark):
    texts = ["", "a", "a b", " a", "a ", "a  b", " a", "a　", "a \n", "a b", "\ta", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.coalesce((t != strip_blanks(t)) | t.contains("  "), F.lit(False))
    assert rows(frame.select(F.coalesce(quality._has_blanks(t), F.lit(False)))) == rows(frame.select(plain))
