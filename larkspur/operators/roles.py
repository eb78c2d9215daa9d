"""What the columns of a table mean: roles by their names, kinds and keys by their cells.

Names are a schema's few strings and are read on the driver; whatever concerns cells is
an aggregate over the whole table.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import numeric_cell, present
from larkspur.functions.rownumbers import numbered
from larkspur.operators.profile import period_time

#: Names of each role, in the order in which roles are tried.
ALIASES = {
    "EVENT_ID": ["ID обращения", "request_id", "event_id", "event id", "transaction_id", "transaction id", "operation_id", "operation id", "id события", "id транзакции", "id операции"],
    "EVENT_TIMESTAMP": ["Дата и время обращения", "submitted_at", "timestamp", "event_time", "event time", "transaction_time", "transaction time", "created_at", "date_time", "datetime", "дата", "время", "дата события", "время события", "дата транзакции", "время транзакции"],
    "EVENT_TYPE": ["Тип обращения", "event_type", "event type", "action", "operation", "transaction_type", "transaction type", "status", "category", "тип события", "действие", "операция", "тип операции", "тип транзакции", "статус", "категория"],
    "EVENT_VALUE": ["amount", "value", "transaction_amount", "transaction amount", "сумма", "значение"],
    "ENTITY_ID": ["entity_id", "entity id", "account_id", "account id", "customer_id", "customer id", "user_id", "user id", "device_id", "device id", "order_id", "order id", "source_id", "source id", "client_id", "client id", "id клиента", "идентификатор клиента", "id пользователя", "id устройства", "id заказа", "счет", "счёт"],
    "TARGET_NUMERIC": ["risk_score", "risk score", "риск-балл", "риск балл", "балл риска", "default_flag", "default flag", "churn_flag", "churn flag"],
    "TARGET_CATEGORY": ["risk_category", "risk category", "категория риска"],
    "CURRENT_DELINQUENCY": ["current_delinquency", "просрочка текущая", "текущая просрочка"],
    "DELINQUENCIES_12M": ["delinquencies_12m", "просрочек за 12 мес", "просрочки за 12 месяцев"],
    "CREDIT_RATING": ["credit_rating", "credit rating", "кредитный рейтинг"],
    "DTI": ["dti", "dti %", "dti, %"],
}
#: Names that count only whole; a name without a role; names of targets.
WHOLE_ONLY = {"category", "категория", "request id", "submitted at", "id обращения", "дата и время обращения", "тип обращения"}
NO_ROLE = "дата ответа/закрытия"
TARGET_NAMES = ("risk_score", "default_flag", "churn_flag", "risk_category")
#: Names of identifiers.
IDENTITY = re.compile(r"^id$|_id$|^id_|client|customer|account|entity", re.IGNORECASE)

SOURCE_ROW = "__source_row__"


def header(name: str) -> str:
    """Compatibility forms, lower case; dashes and punctuation are single spaces."""
    text = unicodedata.normalize("NFKC", name).strip().lower()
    return " ".join(re.sub(r"[‐‑‒–—−_\-(),.%]+", " ", text).split())


_KNOWN = [(role, header(name)) for role, names in ALIASES.items() for name in names]


def role_of(name: str) -> str:
    """The first role whose name the header is, or begins with."""
    text = header(name)
    if text == NO_ROLE:
        return "OTHER"
    return next((role for role, known in _KNOWN if text == known or known not in WHOLE_ONLY and text.startswith(f"{known} ")), "OTHER")


def header_roles(columns: list[str]) -> list[tuple[str, str, str]]:
    """(column, header, role); in tables of requests a service type is the event type."""
    found = [(c, header(c), role_of(c)) for c in columns]
    names = {h for _, h, _ in found}
    if {"request id", "submitted at"} <= names:
        found = [(c, h, "EVENT_TYPE" if h == "service type" else r) for c, h, r in found]
    return found


def column_of(columns: list[str], role: str) -> str | None:
    """The column of a role: the first, but of event types a request's or a service's."""
    of_role = [(c, h) for c, h, r in header_roles(columns) if r == role]
    for special in ("тип обращения", "service type") if role == "EVENT_TYPE" else ():
        if found := next((c for c, h in of_role if h == special), None):
            return found
    return of_role[0][0] if of_role else None


def _there(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def kinds(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """empty, boolean, numeric, datetime or categorical by all cells: one aggregate."""
    columns = columns or df.columns
    if not columns:
        return {}

    def facts(c: str) -> Column:
        cell = F.col(f"`{c}`").cast("string")
        here = _there(cell)
        dated = F.try_to_timestamp(cell).isNotNull()
        return F.struct(F.count_if(here).alias("n"), F.count_if(here & cell.isin("true", "false")).alias("truth"), F.count_if(here & numeric_cell(cell).isNotNull()).alias("numbers"), F.count_if(here & dated).alias("dates"))

    row = df.agg(*[facts(c).alias(f"c{k}") for k, c in enumerate(columns)]).first()

    def kind(name: str, x) -> str:
        if not x.n:
            return "empty"
        if x.truth == x.n:
            return "boolean"
        if x.numbers == x.n:
            return "numeric"
        return "datetime" if x.dates == x.n and re.search("date|time|timestamp|period", name, re.IGNORECASE) else "categorical"

    return {c: kind(c, row[f"c{k}"]) for k, c in enumerate(columns)}


def entity_column(df: DataFrame) -> str:
    """The first identifying column without gaps or repeats, else ``__source_row__``.

    One aggregate counts the cells of all candidates and sketches their distinct values;
    only columns that may be unique are grouped, which stops at the first repeat.
    """
    named = [c for c in df.columns if role_of(c) == "ENTITY_ID" or IDENTITY.search(c)]
    if not named:
        return SOURCE_ROW
    cell = lambda c: F.col(f"`{c}`").cast("string")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(_there(cell(c))).alias("n"), F.approx_count_distinct(cell(c), 0.02).alias("d")).alias(f"c{k}") for k, c in enumerate(named)]).first()
    for k, c in enumerate(named):
        # Six standard errors of the sketch.
        if row[f"c{k}"].n == row.n and row[f"c{k}"].d >= row.n * 0.88 and df.groupBy(cell(c)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return c
    return SOURCE_ROW


@dataclass(frozen=True)
class Target:
    """What a table is analysed for, and how that was decided."""

    column: str | None
    source: str = "NONE"
    kind: str | None = None
    authoritative: bool = False


def resolve_target(df: DataFrame, explicit: str | None = None, known: dict[str, str] | None = None) -> Target:
    """The chosen column, else a column with a target's role or name; never an identifier."""
    known = known or kinds(df)
    wanted = {"numeric": "NUMERIC", "categorical": "CATEGORICAL"}

    def usable(column: str | None, source: str) -> Target | None:
        if column not in df.columns or IDENTITY.search(column) or known[column] not in wanted:
            return None
        return Target(column, source, wanted[known[column]], True)

    if explicit is not None:
        return usable(explicit, "EXPLICIT") or Target(None)
    tried = [column_of(df.columns, role) for role in ("TARGET_NUMERIC", "TARGET_CATEGORY")]
    tried += [next((c for c in df.columns if c.lower() == name), None) for name in TARGET_NAMES]
    return next((t for c in tried if (t := usable(c, "KNOWN_ALIAS"))), Target(None))


@dataclass(frozen=True)
class Semantics:
    """The columns of an event log."""

    timestamp: str
    event_type: str
    event_id: str | None = None
    entity: str | None = None
    value: str | None = None


def event_semantics(columns: list[str]) -> Semantics:
    """Roles of a log's columns; times and types are needed, ids, entities and values not."""
    at, kind = column_of(columns, "EVENT_TIMESTAMP"), column_of(columns, "EVENT_TYPE")
    if not at or not kind:
        raise ValueError("an event log needs columns of times and of event types")
    return Semantics(at, kind, *(column_of(columns, role) for role in ("EVENT_ID", "ENTITY_ID", "EVENT_VALUE")))


def source_rows(df: DataFrame, out: str = "source_row") -> DataFrame:
    """Rows of Parquet files numbered from 1 by file name and place, however they are read.

    Readers know a row's place in its file, so only the sizes of the files are added up.
    """
    from pyspark.sql import Window

    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = rows.groupBy("__file").agg(F.max("__at").alias("__last"))
    before = F.coalesce(F.sum(F.col("__last") + 1).over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("__file", before.alias("__before")), "__file").withColumn(out, (F.col("__before") + F.col("__at") + 1).cast("bigint")).drop("__file", "__at", "__before")


def normalized_events(df: DataFrame, semantics: Semantics | None = None, row: str | None = None) -> DataFrame:
    """source_row, event_id, entity_id, timestamp, micros, event_type, value of a log.

    An event without an id is named by its row, one without an entity belongs to all
    events, and a value that is no finite number is null.  ``row`` names the column of
    row numbers; without it rows are numbered in the order of their partitions.
    """
    s = semantics or event_semantics(df.columns)
    rows = numbered(df, "__row", first=1) if row is None else df.withColumn("__row", F.col(f"`{row}`"))
    cell = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    named = lambda c, other: F.when(present(cell(c)), cell(c)).otherwise(other)
    # A cell of this column is a number only as it stands, white space around it aside.
    plain = F.trim(cell(s.value))
    value = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    at = period_time(cell(s.timestamp))
    return rows.select(
        F.col("__row").cast("bigint").alias("source_row"),
        named(s.event_id, F.concat(F.lit("ROW-"), F.col("__row").cast("string"))).alias("event_id"),
        named(s.entity, F.lit("ALL_EVENTS")).alias("entity_id"),
        cell(s.timestamp).alias("timestamp"),
        F.unix_micros(at).alias("micros"),
        cell(s.event_type).alias("event_type"),
        F.when(F.abs(value) < float("inf"), value).alias("value"),
    )
