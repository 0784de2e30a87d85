import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spendloom import schema
from spendloom.session import new_folder, shared_folder
from spendloom.sources import evalset, tables, workbook
from tests.conftest import rows

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_workbook(path, sheet_rows, shared):
    """A minimal workbook: text cells through the shared strings, numbers as they are."""
    cells = []
    for r, row in enumerate(sheet_rows, 1):
        line = []
        for c, value in enumerate(row):
            if value is None:
                continue
            ref = f"{chr(65 + c)}{r}"
            if isinstance(value, str) and value.startswith("inline:"):
                line.append(f'<c r="{ref}" t="inlineStr"><is><t>{value[7:]}</t></is></c>')
            elif isinstance(value, str):
                if value not in shared:
                    shared.append(value)
                line.append(f'<c r="{ref}" t="s"><v>{shared.index(value)}</v></c>')
            else:
                line.append(f'<c r="{ref}"><v>{value}</v></c>')
        cells.append(f'<row r="{r}">{"".join(line)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        strings = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")


def test_workbooks_become_text(spark, tmp_path):
    write_workbook(
        tmp_path / "a.xlsx",
        [["Region", "Contract Amount", "Award Reference No."], ["NCR", 12.5, None], [None, 45678, "inline:x&amp;y"], []],
        [],
    )
    write_workbook(tmp_path / "b.xlsx", [["Contract Amount", "New"], [7, "n"]], [])
    paths = [str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")]
    bronze = tables.bronze_from_workbooks(spark, paths, "2025-Q1")
    assert bronze.columns == ["contract_amount", "region", "New", "award_ref", "quarter"]
    assert set(bronze.dtypes) == {(c, "string") for c in bronze.columns}
    assert sorted(rows(bronze), key=str) == sorted(
        [
            ("12.5", "NCR", None, None, "2025-Q1"),
            ("45678", None, None, "x&y", "2025-Q1"),
            ("7", None, "n", None, "2025-Q1"),
        ],
        key=str,
    )
    assert workbook.read_workbooks(spark, paths, ["Region"]).count() == 3


def test_cells_under_blank_and_repeated_headings_stay(spark, tmp_path):
    sheet = [["Region", None, "region", "Region_1", "Region"], ["a", "b", "c", "d", "e", "f"], [None, None, None, None, None, None, None, 7]]
    write_workbook(tmp_path / "a.xlsx", sheet, [])
    got = workbook.read_workbooks(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["Region", "column_B", "region_2", "Region_1", "Region_3", "column_F", "column_H"]
    assert rows(got, "Region") == [(None, None, None, None, None, None, "7"), ("a", "b", "c", "d", "e", "f", None)]
    assert workbook._letters(0) + workbook._letters(25) + workbook._letters(26) + workbook._letters(701) + workbook._letters(702) == "AZAAZZAAA"


def test_sheets_are_taken_in_the_workbooks_order(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="{r}"/>' for k, (n, r) in enumerate([("Chart", "r3"), ("Data", "r2"), ("Notes", "r1")], 1))
    parts = {"r1": "worksheets/sheet1.xml", "r2": "/xl/worksheets/sheet2.xml", "r3": "chartsheets/sheet1.xml"}
    with zipfile.ZipFile(path, "w") as book:
        for k, cell in (("worksheets/sheet1", "note"), ("worksheets/sheet2", "data"), ("chartsheets/sheet1", "chart")):
            line = "".join(f'<row><c t="inlineStr"><is><t>{t}</t></is></c></row>' for t in (cell, f"{cell} 1"))
            book.writestr(f"xl/{k}.xml", f"<worksheet {NS}><sheetData>{line}</sheetData></worksheet>")
        book.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in parts.items()) + "</Relationships>")
    first, named = workbook.read_workbooks(spark, str(path)), workbook.read_workbooks(spark, str(path), sheet="Notes")
    assert (first.columns, rows(first)) == (["data"], [("data 1",)])
    assert (named.columns, rows(named)) == (["note"], [("note 1",)])
    with pytest.raises(Exception, match="without a worksheet Gone"):
        workbook.read_workbooks(spark, str(path), sheet="Gone").collect()


def test_csv_and_parquet_bronze(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Region,"Contract Amount"\nNCR,"1,234.50"\n')
    csv = tables.bronze_from_csv(spark, str(tmp_path / "x.csv"), "2025-Q2")
    assert rows(csv) == [("NCR", "1,234.50", "2025-Q2")]
    spark.range(2).select(F.col("id").alias("Line Item No")).write.parquet(str(tmp_path / "p"))
    parquet = tables.bronze_from_parquet(spark, [str(tmp_path / "p")], "2025-Q2")
    assert parquet.dtypes == [("line_item_no", "string"), ("quarter", "string")]


def test_headings_round_trip(spark):
    df = spark.createDataFrame([("1", "2")], "agency string, award_ref string")
    assert schema.to_headings(df).columns == ["Procuring Entity (PE)", "Award Reference No."]
    assert schema.to_internal(schema.to_headings(df)).columns == df.columns
    assert len(schema.HEADINGS) == 48


def test_refresh_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *pairs: spark.createDataFrame(list(pairs), "v int, quarter string")
    tables.refresh_partitions(make((1, "a"), (2, "b")), path)
    tables.refresh_partitions(make((3, "b")), path)
    assert rows(spark.read.parquet(path).select("v", "quarter"), "v") == [(1, "a"), (3, "b")]


def test_append_new_is_idempotent_and_skips_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    tables.append_new(frame, path, "k")
    tables.append_new(frame, path, "k")
    assert rows(spark.read.parquet(path)) == [("a", 1)]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, y string")
    assert rows(tables.union_quarters([a, b]), "x") == [(1, None), (2, "y")]


def test_table_discovery(spark):
    spark.range(1).createOrReplaceTempView("y2025_q1_awards_typed")
    spark.range(1).createOrReplaceTempView("y2025_q1_awards_raw")
    assert tables.silver_tables(spark) == ["y2025_q1_awards_typed"]



def test_evaluation_set_files(spark, tmp_path):
    frame = spark.createDataFrame([("q", "i", "n", "c", "s")], evalset.QUESTION_SCHEMA)
    evalset.write_json(frame, str(tmp_path / "set"))
    assert rows(evalset.read_questions(spark, str(tmp_path / "set"))) == rows(frame)
    (tmp_path / "array.json").write_text('[{"question": "q"},\n {"question": "r", "category": "c"}]')
    assert evalset.read_questions(spark, str(tmp_path / "array.json"), array_file=True).count() == 2


def test_shared_folder_comes_from_the_session(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, _: {"spark.checkpoint.dir": "/shared"}[key]))
    assert shared_folder(named) == "/shared"
    assert new_folder(named, "x").startswith("/shared/x-")
    assert new_folder(named, "x") != new_folder(named, "x")
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn")
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_copies_of_a_key_in_one_batch_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "keyed")
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), ("a", None)], "k string, v int")
    tables.append_new(batch, path, "k")
    tables.append_new(batch, path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3)]


def test_only_missing_files_mean_no_table(spark, tmp_path):
    assert not tables.table_exists(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "_SUCCESS").write_text("")
    assert tables.read_or_empty(spark, str(tmp_path / "empty"), "v int").count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)footer|corrupt|parquet"):
        tables.read_or_empty(spark, str(tmp_path / "broken"), "v int").count()
