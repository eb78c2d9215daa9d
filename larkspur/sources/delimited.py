"""Comma- or semicolon-separated files and JSON datasets, every cell a string."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = re.compile(r'"(?:[^"]|"")*(?:"|\Z)')
_PEEK_LINES = 64


def delimiter(text: str) -> str:
    """';' if the first record has more of them outside quotes than commas, else ','."""
    record = re.split(r"[\r\n]", _QUOTED.sub("", text), maxsplit=1)[0]
    return ";" if record.count(";") > record.count(",") else ","


def headers(cells: list[str]) -> list[str]:
    """Trimmed names, column_n for empty ones; the same name twice is an error."""
    names = [(cell or f"column_{k}").strip() for k, cell in enumerate(cells, 1)]
    if len(set(names)) != len(names):
        raise ValueError("duplicate column headers after normalization")
    return names


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), r"(?U)^\s+|\s+$", "")


def normalize_rows(df: DataFrame) -> DataFrame:
    """Empty cells as null; rows without any cell are dropped."""
    out = df.select(*[F.nullif(trimmed(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    return out.dropna("all")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` that share one header.  Quoted cells may hold delimiters, quotes and line breaks.

    Only the first lines reach the driver, for the delimiter and the names.
    """
    n, peek = _PEEK_LINES, ""
    while True:
        lines = spark.read.text(path).take(n)
        peek = "\n".join(r[0] for r in lines).removeprefix("\ufeff")
        # A first record with line breaks in its quotes may go on behind these lines.
        if len(lines) < n or peek.count('"') % 2 == 0 or re.search(r'[\r\n]', _QUOTED.sub("", peek)):
            break
        n *= 4
    if not peek:
        raise ValueError("the file is empty")
    sep = delimiter(peek)
    names = headers([x.strip() for x in next(csv.reader(io.StringIO(peek), delimiter=sep))])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).options(sep=sep, quote='"', escape='"', multiLine=True, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    return normalize_rows(rows)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One dataset row a line; a schema makes the scan a single pass."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mode", "FAILFAST").json(path)
