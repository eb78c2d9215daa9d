"""XLSX workbooks as rows of cells.

Files come through Spark's binary reader, so any store that Spark reads will do,
one file a task; a sheet is parsed as a stream of rows.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, sheet_no int, sheet string, row int, level int, cells array<string>"
_BATCH = 2000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that are dates in every workbook.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dated = _DATE_FORMATS | {k for k, code in custom.items() if re.search("[ymdhs]", code.lower()) and "general" not in code.lower()}
    styles = root.find(f"{_MAIN}cellXfs")
    return [int(x.get("numFmtId", 0)) in dated for x in styles] if styles is not None else []


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) in the order of the workbook."""
    links = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return [(s.get("name"), (t if (t := links[s.get(_LINK)].lstrip("/")).startswith("xl/") else f"xl/{t}")) for s in found]


def _column(reference: str) -> int:
    at = 0
    for letter in reference:
        if not letter.isalpha():
            break
        at = at * 26 + ord(letter.upper()) - 64
    return at - 1


def _text(cell: ET.Element, shared: list[str], dates: list[bool]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind != "n":
        return value
    number, style = float(value), int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        day = dt.datetime(1899, 12, 30) + dt.timedelta(milliseconds=round(number * 86_400_000))
        return f"{day:%Y-%m-%dT%H:%M:%S}.{day.microsecond // 1000:03d}Z"
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: list[bool], wanted: set[int] | None = None) -> Iterator[tuple[int, int, list[str | None]]]:
    """(row from 1, outline level, cells) of one sheet; cells of columns that are not wanted
    are not decoded and stand as '-' if they hold anything."""
    at = 0
    with book.open(part) as stream:
        for _, node in ET.iterparse(stream):
            if node.tag != f"{_MAIN}row":
                continue
            at = int(node.get("r", at + 1))
            cells: list[str | None] = []
            for cell in node.iter(f"{_MAIN}c"):
                k = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                cells += [None] * (k - len(cells))
                cells.append(_text(cell, shared, dates) if wanted is None or k in wanted else "-" if len(cell) else None)
            yield at, int(node.get("outlineLevel", 0)), cells
            node.clear()


def rows_of(content: bytes) -> Iterator[tuple[int, str, int, int, list[str | None]]]:
    """(sheet number, sheet, row from 1, outline level, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared(book), _date_styles(book)
        for number, (name, part) in enumerate(_sheets(book)):
            for row in sheet_rows(book, part, shared, dates):
                yield number, name, *row


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets of the workbooks under ``path``."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet_no", "sheet", "row", "level", "cells"]
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"]):
                held: list[tuple] = []
                for row in rows_of(content):
                    held.append((source, *row))
                    if len(held) == _BATCH:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").load(path).dropDuplicates(["path", "length", "modificationTime"])
    return files.select("path", "content").mapInPandas(task, SCHEMA)
