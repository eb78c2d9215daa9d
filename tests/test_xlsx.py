"""The xlsx data source: sheets as partitions, options, pruning and refusals."""

import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.sources import delimited, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets):
    """A workbook of inline texts; None leaves a cell out."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            cells = lambda i, row: "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v is not None)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{''.join(f'<row r=\"{i}\">{cells(i, row)}</row>' for i, row in enumerate(rows, 1))}</sheetData></worksheet>")


@pytest.fixture
def folder(spark, tmp_path):
    xlsx.register(spark)
    body = [[f"k{k}", str(k), None if k % 2 else "x"] for k in range(5)]
    book(tmp_path / "a.xlsx", {"One": [["name", None, " note "], *body, [None, None, ""], ["last", "9", "y"]], "Two": [["name", "other"], *[[f"t{k}", "z"] for k in range(3)]]})
    book(tmp_path / "b.xlsx", {"One": [["name"], ["1"], ["2"], ["3"]], "Short": [["name"], ["1"], ["2"]]})
    return tmp_path


def test_first_sheet_with_its_header(spark, folder):
    got = spark.read.format("xlsx").load(str(folder / "a.xlsx"))
    assert got.columns == ["_file", "_sheet", "_row", "name", "column_2", "note"]
    rows = got.orderBy("_row").collect()
    assert [(r._row, r.name, r.column_2, r.note) for r in rows] == [(k + 2, f"k{k}", str(k), None if k % 2 else "x") for k in range(5)] + [(8, "last", "9", "y")]


def test_sheets_are_read_by_tasks_of_their_own(spark, folder):
    every = spark.read.format("xlsx").option("sheet", "*").load(str(folder / "a.xlsx"))
    assert every.rdd.getNumPartitions() == 2
    assert {(r._sheet, r.p) for r in every.select("_sheet", F.spark_partition_id().alias("p")).distinct().collect()} == {("One", 0), ("Two", 1)}
    two = spark.read.format("xlsx").option("sheet", "Two").load(str(folder))
    assert two.columns[3:] == ["name", "other"] and two.count() == 3
    assert spark.read.format("xlsx").load(str(folder)).groupBy("_file").count().count() == 2


def test_only_named_columns_are_read(spark, folder, monkeypatch):
    pruned = spark.read.format("xlsx").schema("note string, absent string, _row int").load(str(folder / "a.xlsx"))
    assert sorted((r._row, r.note, r.absent) for r in pruned.collect() if r.note) == [(2, "x", None), (4, "x", None), (6, "x", None), (8, "y", None)]
    # A row that only other columns fill is still a row.
    assert pruned.count() == 6
    seen = []
    text = xlsx.B._text
    monkeypatch.setattr(xlsx.B, "_text", lambda cell, *more: seen.append(cell.get("r")) or text(cell, *more))
    reader = xlsx.XlsxReader({}, pruned.schema, xlsx._chosen(str(folder / "a.xlsx"), None))
    list(reader.read(reader.partitions()[0]))
    assert {c[0] for c in seen if not c.endswith("1")} == {"C"}


def test_filters_leave_out_sheets(spark, folder):
    from pyspark.sql.datasource import EqualTo, IsNotNull

    reader = xlsx.XlsxReader({}, spark.read.format("xlsx").load(str(folder)).schema, xlsx._chosen(str(folder / "a.xlsx"), "*"))
    left = list(reader.pushFilters([EqualTo(("_sheet",), "Two"), IsNotNull(("name",)), EqualTo(("name",), "t1")]))
    assert [p.name for p in reader.partitions()] == ["Two"] and len(left) == 2


def test_short_and_absent_sheets_are_refused(spark, folder):
    short = spark.read.format("xlsx").option("sheet", "Short").load(str(folder / "b.xlsx"))
    with pytest.raises(Exception, match="2 rows; 3 are needed"):
        short.collect()
    assert spark.read.format("xlsx").options(sheet="Short", leastRows="2").load(str(folder / "b.xlsx")).count() == 2
    with pytest.raises(Exception, match="no such sheet"):
        spark.read.format("xlsx").option("sheet", "None").load(str(folder)).schema
    book(folder / "c.xlsx", {"S": [["a", " a"], ["1", "2"], ["1", "2"], ["1", "2"]]})
    with pytest.raises(Exception, match="duplicate column headers"):
        spark.read.format("xlsx").load(str(folder / "c.xlsx")).schema


def test_a_header_of_many_lines(spark, tmp_path):
    name = "\n".join(f"line {k}" for k in range(200))
    (tmp_path / "f.csv").write_text(f'"{name}";b\n1;2\n3;4\n')
    got = delimited.scan(spark, str(tmp_path / "f.csv"))
    assert got.columns == [name, "b"] and [tuple(r) for r in got.collect()] == [("1", "2"), ("3", "4")]
