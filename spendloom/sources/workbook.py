"""Spreadsheet reader: each workbook is one unit of work, cells come out as text.

A workbook is a zip archive and cannot be split, and the format holds at most 1,048,576 rows, so the task
that owns a file is bounded by the format. Many workbooks are read in parallel. Files come through Spark's reader, so
they may lie in any store that Spark reads.

A column is known by its heading. A repeated heading (case doesn't count) gets ``_1``, ``_2`` and so on from left to
right; cells under a blank or missing heading form a column named ``column_`` and its letters, if there are any.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BATCH = 10_000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if _local(node.tag) == "si":
                strings.append("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))
                node.clear()
    return strings


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of the named sheet, or of the first one in the workbook's own order."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
            if _local(node.tag) != "sheet" or sheet not in (None, node.get("name")):
                continue
            target = targets.get(next((v for k, v in node.attrib.items() if _local(k) == "id"), None), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            # A chart may be a sheet too; rows are in worksheets only.
            if part in names and "worksheets/" in part:
                return part
    found = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
    if not found or sheet is not None:
        raise ValueError("workbook without a worksheet" if sheet is None else f"workbook without a worksheet {sheet}")
    return min(found, key=lambda n: (len(n), n))


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - 64
    return index - 1


def _cell_text(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    raw = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if raw is None:
        return None
    return strings[int(raw)] if kind == "s" else raw


def _letters(index: int) -> str:
    out, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _names(heading: list[str | None], width: int) -> list[str]:
    """A name of its own for each of the first ``width`` columns."""
    seen: set[str] = {h.lower() for h in heading if h}
    used: set[str] = set()
    out = []
    for i in range(width):
        name = (heading[i] if i < len(heading) else None) or f"column_{_letters(i)}"
        k, free = 0, name
        while free.lower() in used or (k and free.lower() in seen):
            k += 1
            free = f"{name}_{k}"
        used.add(free.lower())
        out.append(free)
    return out


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a worksheet, the first by default, one text (or None) per cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _shared_strings(book)
        with book.open(_sheet_part(book, sheet)) as part:
            for _, node in ElementTree.iterparse(part):
                if _local(node.tag) != "row":
                    continue
                row: list[str | None] = []
                for position, cell in enumerate(c for c in node if _local(c.tag) == "c"):
                    reference = cell.get("r")
                    at = _column_index(reference) if reference else position
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell_text(cell, strings)
                node.clear()
                yield row


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(listed).select("path", "content")


def workbook_columns(spark: SparkSession, paths: str | list[str], sheet: str | None = None) -> list[str]:
    """Names of the columns that have a heading or a cell, in order of first appearance; reads the workbooks once."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                stream = sheet_rows(content, sheet)
                heading = next(stream, [])
                filled = {i for i, h in enumerate(heading) if h}
                width = len(heading)
                for row in stream:
                    width = max(width, len(row))
                    filled.update(i for i, v in enumerate(row) if v is not None and i not in filled)
                named = [(i, n) for i, n in enumerate(_names(heading, width)) if i in filled]
                yield pd.DataFrame(named, columns=["position", "heading"])

    found = _files(spark, paths).mapInPandas(headers, "position int, heading string")
    # one row per distinct heading, so the result is as wide as a table, whatever the number of files
    rows = found.groupBy("heading").agg(F.min("position").alias("position")).collect()
    return [r["heading"] for r in sorted(rows, key=lambda r: (r["position"], r["heading"]))]


def read_workbooks(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, sheet: str | None = None
) -> DataFrame:
    """All cells of a sheet as text, columns matched by name; a column a workbook lacks is NULL there."""
    wanted = columns or workbook_columns(spark, paths, sheet)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                stream = sheet_rows(content, sheet)
                heading = next(stream, [])
                spots: list[int | None] = []
                width = -1
                picked: list[list[str | None]] = []
                for row in stream:
                    # Names of columns don't depend on how many come after them.
                    if max(len(row), len(heading)) > width:
                        width = max(len(row), len(heading))
                        at = {name: i for i, name in enumerate(_names(heading, width))}
                        spots = [at.get(c) for c in wanted]
                    if any(v is not None for v in row):
                        picked.append([row[i] if i is not None and i < len(row) else None for i in spots])
                    if len(picked) == ROWS_PER_BATCH:
                        yield pd.DataFrame(picked, columns=wanted, dtype=object)
                        picked = []
                if picked:
                    yield pd.DataFrame(picked, columns=wanted, dtype=object)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
    return _files(spark, paths).mapInPandas(rows, schema)
