import pytest
from pyspark.sql import functions as F

from spendloom.operators import analytics as an
from spendloom.operators.audit import ENGINE_WORDS, FORBIDDEN_WORDS, RefusedStatementError, audit_statements, run_sql, try_sql
from spendloom.plans import questions as q
from tests.conftest import rows


@pytest.fixture
def awards(spark):
    data = [
        ("DEPARTMENT OF HEALTH - MAIN", "NCR", "Goods", "ACME", "Micro", "2025-02-01", "120", "100", "1", "2025-Q1"),
        ("DOH REGION VII", "Region VII", "Civil Works", "BUILD", "Large", "2025-05-01", "500", "500", "2", "2025-Q2"),
        ("PSA", "NCR", "Goods", "ACME", None, "2024-03-01", "90", "80", "3", "2024-Q1"),
        ("CITY OF CEBU", "Region VII", "Civil Works", "BUILD", "Small", "2025-12-31", "10", "20", "4", "2025-Q4"),
    ]
    names = "agency region classification awardee awardee_size award_date approved_budget contract_amount award_ref quarter".split()
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    return df.withColumns(
        {
            "award_date": F.col("award_date").cast("date"),
            "approved_budget": F.col("approved_budget").cast("decimal(15,2)"),
            "contract_amount": F.col("contract_amount").cast("decimal(15,2)"),
            "notice_title": F.lit("Flood control works"),
            "item_name": F.lit("Item"),
            "org_group": F.lit("LGU"),
            "city": F.lit("Cebu City"),
            "procurement_mode": F.lit("Public Bidding"),
            "government_branch": F.when(F.col("award_ref") != "3", "Executive"),
        }
    )


def test_alias_covers_name_and_acronym(awards):
    assert awards.filter(an.agency_is("doh")).count() == 2
    assert awards.filter(an.agency_is("psa")).count() == 1
    assert awards.filter(an.agency_is("city of")).count() == 1


def test_scope_is_built_from_what_is_given(awards):
    assert an.scoped(awards).count() == 4
    assert an.scoped(awards, region="vii").count() == 2
    assert an.scoped(awards, region="vii", agency="doh").count() == 1


def test_points_and_periods(awards):
    assert rows(an.point_aggregate(awards, an.in_year(2025))) == [(620.0, 3)]
    assert rows(an.point_aggregate(awards, an.between_dates("2025-02-01", "2025-05-01"))) == [(600.0, 2)]
    assert rows(an.point_aggregate(awards, an.in_quarter("2024-Q1"))) == [(80.0, 1)]
    assert rows(an.point_aggregate(awards, F.col("region") == "nowhere")) == [(0.0, 0)]
    assert rows(an.spend_totals(awards)) == [(700.0, 4, 175.0)]
    assert rows(an.spend_totals(awards.limit(0))) == [(0.0, 0, 0.0)]


def test_shapes(awards):
    assert rows(an.profile(awards, "classification")) == [("Civil Works", 2, 520.0, 260.0), ("Goods", 2, 180.0, 90.0)]
    assert rows(an.leaderboard(awards, "awardee", 1)) == [("BUILD", 2, 520.0)]
    assert rows(an.compare(awards, "region", ["NCR"])) == [("NCR", 2, 180.0)]
    assert rows(an.budget_savings(awards)) == [(30.0, 2)]
    assert [r["award_ref"] for r in an.largest_contracts(awards, 2).collect()] == ["2", "1"]


def test_answer_totals_take_the_first_usable_value(spark):
    answer = spark.createDataFrame([("", "2"), ("5", "9"), ("x", None)], "total_spend string, amount string")
    assert rows(an.answer_totals(answer, ["contract_amount", "total_spend", "amount"])) == [(7.0, 3, 7.0 / 3)]
    assert rows(an.answer_totals(answer.limit(0), ["amount"])) == [(0.0, 0, 0.0)]
    assert rows(an.answer_totals(answer, ["nothing"])) == [(0.0, 3, 0.0)]


def test_questions(awards):
    assert rows(q.top_suppliers(awards, "DOH", 2025)) == [("BUILD", 1, 500.0), ("ACME", 1, 100.0)]
    assert rows(q.agency_spend(awards, "PSA", "2024-Q1")) == [(80.0, 1)]
    assert q.largest_in_region(awards, "Region VII").first()["award_ref"] == "2"
    assert q.compare_classifications(awards, "Goods", "Civil Works").count() == 2
    assert q.compare_modes(awards, "Public Bidding").count() == 1
    assert [r["award_ref"] for r in q.small_firm_contracts(awards).collect()] == ["1", "4"]
    assert rows(q.savings(awards)) == [(30.0, 2)]
    assert rows(q.supplier_contracts(awards, "acme")) == [(180.0, 2)]
    assert rows(q.city_spend(awards, "cebu city")) == [(700.0, 4)]
    assert q.agency_profile(awards, "DOH").count() == 2
    assert rows(q.branch_spend(awards)) == [("Executive", 3, 620.0)]
    assert q.largest_on_topic(awards, "flood", "DOH", 1).first()["award_ref"] == "2"
    assert rows(q.topic_spend(awards, "submarine")) == [(0.0, 0)]
    assert q.largest_by_organisation(awards, ["LGU"], ["Goods"]).count() == 2


def in_a_read(word):
    """The word where a read could carry it, in mixed case."""
    return f"with few as (select 1) select {word.title()} from all_awards where 2 > 1"


REFUSED = [
    *map(in_a_read, FORBIDDEN_WORDS),
    *map(in_a_read, ENGINE_WORDS),
    "select 1; select 2",
    "\n;;",
    "describe all_awards",
    "select reflect('java.lang.System', 'exit') from all_awards",
    "select `java_method`('java.lang.System', 'lineSeparator') from all_awards",
    "select system.builtin.try_reflect('java.lang.System', 'lineSeparator')",
    "select * from parquet.`/elsewhere/part.parquet`",
    "select * from all_awards join salaries on true",
    "select * from all_awards a, salaries",
    "select * from/**/salaries",
    "select * from all_awards -- where",
    'select * from "salaries"',
    "select (select max(x) from salaries) from all_awards",
    "select * from range(9)",
]


def test_audit_refuses(spark):
    found = audit_statements(spark.createDataFrame([(s,) for s in REFUSED], "sql string")).collect()
    assert [r["sql"] for r in found if r["allowed"]] == []
    assert all(r["reason"] and r["safe_sql"] is None for r in found)
    assert len(FORBIDDEN_WORDS) == 19


@pytest.mark.parametrize(
    ("statement", "safe"),
    [
        (" select 1; ", "select 1 LIMIT 100"),
        ("select 1 ;", "select 1  LIMIT 100"),
        ("SELECT a FROM all_awards\nLIMIT\t5", "SELECT a FROM all_awards\nLIMIT\t5"),
        ("SELECT created, updated FROM Gold.All_Awards", "SELECT created, updated FROM Gold.All_Awards LIMIT 100"),
        (
            "SELECT 1 FROM all_awards WHERE \"Award Date\" LIKE '2025%' LIMIT 1",
            "SELECT 1 FROM all_awards WHERE CAST(\"Award Date\" AS STRING) LIKE '2025%' LIMIT 1",
        ),
        (
            "WITH a AS (SELECT 'from x -- y' v FROM all_awards), b (c) AS (SELECT v FROM a) SELECT EXTRACT(YEAR FROM c) FROM b JOIN a ON c = v LIMIT 1",
            "WITH a AS (SELECT 'from x -- y' v FROM all_awards), b (c) AS (SELECT v FROM a) SELECT EXTRACT(YEAR FROM c) FROM b JOIN a ON c = v LIMIT 1",
        ),
    ],
)
def test_audit_allows_and_repairs(spark, statement, safe):
    row = audit_statements(spark.createDataFrame([(statement,)], "sql string")).first()
    assert (row["allowed"], row["reason"], row["safe_sql"]) == (True, "", safe)


def test_failures_as_answers(spark, awards):
    good = try_sql(awards, "SELECT COUNT(*) AS n, 'gold.all_awards' AS name FROM gold.all_awards")
    assert good.success and good.error == "" and good.rows.first()["name"] == "gold.all_awards"
    for statement in ("SELECT no_such_column FROM all_awards", "SELECT FROM WHERE", "DROP TABLE all_awards"):
        bad = try_sql(awards, statement)
        assert (bad.success, bad.rows) == (False, None) and bad.error
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("all_awards")] == []


def test_adhoc_sql(spark, awards):
    text = 'SELECT "Region", SUM("Contract Amount") AS spend FROM gold.all_awards WHERE "Awardee Size" = :size GROUP BY "Region"'
    assert [r["Region"] for r in run_sql(awards, text, {"size": "Micro"}).collect()] == ["NCR"]
    dated = run_sql(awards, "SELECT \"Award Date\" FROM all_awards WHERE \"Award Date\" LIKE '2025%'", display=True)
    assert dict(dated.dtypes) == {"Award Date": "string"}
    assert dated.count() == 3
    many = run_sql(awards.crossJoin(spark.range(200)), "SELECT * FROM all_awards")
    assert many.count() == 100
    with pytest.raises(RefusedStatementError):
        run_sql(awards, "DROP TABLE all_awards")
