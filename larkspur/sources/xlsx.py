"""XLSX workbooks as a data source: ``spark.read.format("xlsx").load(path)``.

Every sheet of every workbook is a partition of its own, so large workbooks are read by
as many tasks as they have sheets; a sheet is parsed as a stream of its rows.

Options: ``sheet``, the name of the sheet to read, ``*`` for all, or nothing for the first
of each workbook; ``leastRows``, the fewest rows of a sheet that is read (3).  Columns
are the sheet's first row, as strings, after ``_file``, ``_sheet`` and ``_row``.  With
``.schema(...)`` only the named columns are decoded, and a sheet without one of them gives
nulls.  Filters on ``_file`` and ``_sheet`` leave out whole partitions.
"""

from __future__ import annotations

import fnmatch
import glob
import io
import os
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from larkspur.sources import workbook as B
from larkspur.sources.delimited import headers

LEAST_ROWS = 3
_PLACE = [T.StructField("_file", T.StringType()), T.StructField("_sheet", T.StringType()), T.StructField("_row", T.IntegerType())]


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def files(path: str) -> list[str]:
    """The workbooks of a file, a folder or a pattern, in order."""
    local = _local(path)
    if local is not None:
        found = glob.glob(os.path.join(local, "*.xlsx")) if os.path.isdir(local) else glob.glob(local)
        return sorted(f for f in found if not os.path.basename(f).startswith(("~", ".", "_")))
    from pyarrow import fs

    folder, _, pattern = path.rpartition("/") if "*" in path else (path, "", "*.xlsx")
    store, inner = fs.FileSystem.from_uri(folder)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(f"{folder}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(inner)) if fnmatch.fnmatch(x.base_name, pattern))


def content(path: str) -> bytes:
    local = _local(path)
    if local is not None:
        with open(local, "rb") as source:
            return source.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as source:
        return source.read()


@dataclass
class Sheet(InputPartition):
    """One sheet of one workbook."""

    file: str
    name: str
    part: str


def _chosen(file: str, sheet: str | None) -> list[Sheet]:
    with zipfile.ZipFile(io.BytesIO(content(file))) as book:
        found = [Sheet(file, name, part) for name, part in B._sheets(book)]
    if sheet is None:
        return found[:1]
    return found if sheet == "*" else [x for x in found if x.name == sheet]


def _first_row(sheet: Sheet) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content(sheet.file))) as book:
        for _, _, cells in B.sheet_rows(book, sheet.part, B._shared(book), B._date_styles(book)):
            return headers(["" if c is None else c for c in cells])
    raise ValueError(f"sheet {sheet.name} of {sheet.file} is empty")


class XlsxSource(DataSource):
    """The source of the format ``xlsx``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _sheets(self) -> list[Sheet]:
        return [x for file in files(self.options["path"]) for x in _chosen(file, self.options.get("sheet"))]

    def schema(self) -> T.StructType:
        found = self._sheets()
        if not found:
            raise ValueError(f"no such sheet in {self.options['path']}")
        return T.StructType([*_PLACE, *(T.StructField(name, T.StringType()) for name in _first_row(found[0]))])

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxReader(self.options, schema, self._sheets())


class XlsxReader(DataSourceReader):
    """Rows of the chosen sheets; each with at least ``leastRows`` rows that hold a cell."""

    def __init__(self, options, schema: T.StructType, sheets: list[Sheet]):
        self.names, self.sheets = schema.fieldNames(), sheets
        self.least = int(options.get("leastRows", LEAST_ROWS))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            allowed = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if allowed is not None and f.attribute in (("_sheet",), ("_file",)):
                of = "name" if f.attribute == ("_sheet",) else "file"
                self.sheets = [x for x in self.sheets if getattr(x, of) in allowed]
            else:
                yield f

    def partitions(self) -> list[Sheet]:
        return self.sheets

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        if partition is None:
            return
        names = _first_row(partition)
        place = {name: k for k, name in enumerate(names) if name in self.names}
        waiting: list[tuple] = []
        n = -1
        with zipfile.ZipFile(io.BytesIO(content(partition.file))) as book:
            for at, _, cells in B.sheet_rows(book, partition.part, B._shared(book), B._date_styles(book), set(place.values())):
                if not any(c not in (None, "") for c in cells):
                    continue
                # The first row with a cell is the header.
                n += 1
                if n == 0:
                    continue
                own = {"_file": partition.file, "_sheet": partition.name, "_row": at}
                own |= {name: cells[k] or None for name, k in place.items() if k < len(cells)}
                waiting.append(tuple(own.get(name) for name in self.names))
                if n >= self.least:
                    yield from waiting
                    waiting.clear()
        if n < self.least:
            raise ValueError(f"sheet {partition.name} of {partition.file} has {max(0, n)} rows; {self.least} are needed")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which then pushes filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxSource)
