"""Sheets of a workbook to the planning relations.

A sheet is a frame of (row, cells).  Only its first 20 rows reach the driver, to
find the header; everything else is projection, so a sheet of any length is one
pass.  A missing header or column raises MissingColumn; optional sources may
catch that and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import numeric_cell

HEADER_ROWS = 20

# Column names after ``plain_key``, and the names of months.
SKU = ("код", "код 1с", "код товара", "код номенклатуры", "номенклатура код", "номенклатурный код", "артикул", "sku", "item code", "product code")
NAME = ("номенклатура", "наименование", "название", "название товара", "товар", "product", "product name", "name", "item")
QUANTITY = ("количество", "кол во", "qty", "quantity", "amount")
DATE = ("дата", "дата документа", "дата продажи", "date")
INVOICE = ("номер", "номер документа", "invoice")
WAREHOUSE = ("склад", "warehouse")
SHELF_LIFE = ("осг", "остаток срока годности", "shelf life")
EXPIRY_STATUS = ("днейдоистечения", "дней до истечения", "годен", "статус", "days to expiry")
EXPIRY_DATE = ("срок годности", "годен до", "expiry date")
MULTIPLE = ("кратность", "мин разр к отгр", "moq", "кратность заказа")
NOT_SALES = "(?iu)приходная накладная|заказ покупателя"
MONTHS = (
    ("янв", "январь", "января"),
    ("фев", "февр", "февраль", "февраля"),
    ("мар", "март", "марта"),
    ("апр", "апрель", "апреля"),
    ("май", "мая"),
    ("июн", "июнь", "июня"),
    ("июл", "июль", "июля"),
    ("авг", "август", "августа"),
    ("сен", "сент", "сентябрь", "сентября"),
    ("окт", "октябрь", "октября"),
    ("ноя", "ноябрь", "ноября"),
    ("дек", "декабрь", "декабря"),
)


class MissingColumn(ValueError):
    """The sheet has no such header or column."""


def plain_key(cell: str | None) -> str:
    """Lower case, one letter for yo, other than letters and digits as one space."""
    return re.sub("[^a-zа-я0-9]+", " ", (cell or "").lower().replace("ё", "е")).strip()


def month_of(cell: str | None, year: int | None = None) -> str | None:
    """'yyyy-MM' of a header like 'янв 2024', or of a bare month number in a given year."""
    key = plain_key(cell)
    if year is not None and re.fullmatch("0?[1-9]|1[0-2]", key):
        return f"{year}-{int(key):02d}"
    found = re.search(r"\b(20\d{2})\b", key)
    numbers = [k for word in key.split() for k, names in enumerate(MONTHS, 1) if word in names]
    return f"{found[1]}-{numbers[0]:02d}" if found and numbers else None


class Sheet:
    """A sheet whose header holds, somewhere in its cells, one of each group of names."""

    def __init__(self, rows: DataFrame, *required: Sequence[str]):
        for at, cells in sorted((r["row"], r["cells"]) for r in rows.orderBy("row").select("row", "cells").limit(HEADER_ROWS).collect()):
            keys = [plain_key(c) for c in cells]
            if all(any(name in key for key in keys for name in group) for group in required):
                self.labels, self.keys, self.header = cells, keys, at
                break
        else:
            raise MissingColumn("required headers were not found")
        self.body = rows.filter(F.col("row") > at)

    def where(self, matches: Callable[[int], bool]) -> list[int]:
        return [k for k in range(len(self.keys)) if matches(k)]

    def find(self, names: Sequence[str]) -> int | None:
        return next((k for k, key in enumerate(self.keys) if key in names), None)

    def need(self, names: Sequence[str], label: str) -> int:
        k = self.find(names)
        if k is None:
            raise MissingColumn(f"required column was not found: {label}")
        return k

    @staticmethod
    def text(k: int | None) -> Column:
        """A trimmed cell; the empty text for none."""
        return F.lit("") if k is None else F.coalesce(F.regexp_replace(F.get("cells", F.lit(k)), r"(?U)^\s+|\s+$", ""), F.lit(""))

    @staticmethod
    def number(k: int | None) -> Column:
        return F.lit(None).cast("double") if k is None else numeric_cell(F.replace(F.get("cells", F.lit(k)), F.lit(","), F.lit(".")))


def moment(text: Column) -> Column:
    """A timestamp of an ISO text or of day, month, year with an optional time; null for days that do not exist."""
    part = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"

    def group(k: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, part, k), F.lit("")), F.lit("0"))

    local = F.concat(group(3), F.lit("-"), F.lpad(group(2), 2, "0"), F.lit("-"), F.lpad(group(1), 2, "0"), F.lit(" "), F.lpad(group(4), 2, "0"), F.lit(":"), F.lpad(group(5), 2, "0"), F.lit(":"), F.lpad(group(6), 2, "0"))
    return F.when(text.rlike(part), F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def transactions(rows: DataFrame) -> DataFrame:
    """Sales of a journal; receipts, customer orders, bad dates and empty quantities are no sales."""
    sheet = Sheet(rows, DATE, SKU, QUANTITY)
    date, invoice, sku = sheet.need(DATE, "date"), sheet.need(INVOICE, "invoice"), sheet.need(SKU, "SKU")
    name, quantity = sheet.need(NAME, "name"), sheet.need(QUANTITY, "quantity")
    made = sheet.body.select(
        "row",
        moment(sheet.text(date)).alias("occurred_at"),
        sheet.text(invoice).alias("invoice_number"),
        sheet.text(sheet.find(("документ",))).alias("document"),
        sheet.text(sku).alias("sku"),
        sheet.text(name).alias("product_name"),
        F.nullif(sheet.text(sheet.find(WAREHOUSE)), F.lit("")).alias("warehouse"),
        sheet.number(quantity).alias("source_quantity"),
    )
    kept = made.filter("occurred_at is not null and source_quantity <> 0 and sku <> ''").filter(~F.col("document").rlike(NOT_SALES))
    return kept.withColumn("units_sold", F.abs("source_quantity"))


def monthly(rows: DataFrame, year: int | None = None) -> DataFrame:
    """sku, product_name, month, value of a sheet with a month a row or a month a column.

    A month column's empty cell is a known zero; a month without a column has no row.
    """
    sheet = Sheet(rows, NAME, SKU)
    sku, name = sheet.find(SKU), sheet.need(NAME, "name")
    if sku is None:
        sku = next(iter(sheet.where(lambda k: re.search("номенклатурн.*код", sheet.keys[k]) is not None)), None)
    if sku is None:
        raise MissingColumn("required column was not found: SKU")
    month, quantity = sheet.find(("месяц", "month")), sheet.find(QUANTITY)
    base = sheet.body.filter(sheet.text(sku) != "")
    if month is not None and quantity is not None:
        key = F.translate(F.lower(sheet.text(month)), "ё", "е")
        words = F.split(F.trim(F.regexp_replace(key, "[^a-zа-я0-9]+", " ")), " ")
        numbers = F.create_map(*[F.lit(x) for k, names in enumerate(MONTHS, 1) for n in names for x in (n, f"{k:02d}")])
        named = F.get(F.filter(F.transform(words, lambda w: F.try_element_at(numbers, w)), lambda m: m.isNotNull()), F.lit(0))
        years = F.get(F.filter(words, lambda w: w.rlike(r"^20\d{2}$")), F.lit(0))
        found = F.concat_ws("-", years, named)
        found = F.when(years.isNotNull() & named.isNotNull(), found)
        if year is not None:
            bare = F.array_join(words, " ")
            found = F.when(bare.rlike("^(0?[1-9]|1[0-2])$"), F.concat(F.lit(f"{year}-"), F.lpad(bare, 2, "0"))).otherwise(found)
        made = base.select("row", sheet.text(sku).alias("sku"), F.nullif(sheet.text(name), F.lit("")).alias("name"), found.alias("month"), sheet.number(quantity).alias("value"))
        first = F.coalesce(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("row"))), F.lit(""))
        return made.filter("month is not null").groupBy("sku", "month").agg(first.alias("product_name"), F.sum(F.coalesce("value", F.lit(0.0))).alias("value")).select("sku", "product_name", "month", "value")
    columns = [(k, m) for k, cell in enumerate(sheet.labels) if (m := month_of(cell, year))]
    if not columns:
        raise MissingColumn("no monthly columns were found")
    cells = F.array(*[F.struct(F.lit(m).alias("month"), F.coalesce(sheet.number(k), F.lit(0.0)).alias("value")) for k, m in columns])
    return base.select(sheet.text(sku).alias("sku"), sheet.text(name).alias("product_name"), F.explode(cells).alias("c")).select("sku", "product_name", "c.month", "c.value")


#: The line of a hierarchical report that names its period.
PERIOD = re.compile(r"период:?\s*(\d{2})\.(\d{2})\.(\d{4})\s*-\s*(\d{2})\.(\d{2})\.(\d{4})", re.I)
PERIOD_ROWS = 15


def grouped(rows: DataFrame) -> DataFrame:
    """row, sku (null if the label holds none), product_name, month, units of a
    hierarchical report: the rows of its deepest outline level.

    The period comes from its line, else from the first cell that names a month; the
    quantity column is then the first one from that cell's column on, as far as the
    next filled cell of the month's row.  ``rows`` has row, level and cells.  Only
    the first rows come to the driver.
    """
    head = sorted((r["row"], r["cells"]) for r in rows.orderBy("row").select("row", "cells").limit(HEADER_ROWS).collect())
    month, span = None, None
    top = head[:PERIOD_ROWS]
    dated = next((m for _, cells in top for c in cells if (m := PERIOD.search(c or ""))), None)
    if dated:
        if dated[2] != dated[5] or dated[3] != dated[6]:
            raise ValueError("the report covers more than one month")
        if not 1 <= int(dated[2]) <= 12:
            raise ValueError("the report's period names no month")
        month = f"{dated[3]}-{dated[2]}"
    else:
        for _, cells in top:
            k = next((k for k, c in enumerate(cells) if month_of(c)), None)
            if k is not None:
                after = next((j for j in range(k + 1, len(cells)) if (cells[j] or "").strip()), len(cells) + 1)
                month, span = month_of(cells[k]), (k, after)
                break
    if month is None:
        raise MissingColumn("no period in the first rows of the report")
    found = [(not (span and span[0] <= k < span[1]), at, k) for at, cells in head for k, c in enumerate(cells) if any(name in plain_key(c) for name in QUANTITY)]
    if not found:
        raise MissingColumn("required column was not found: quantity")
    _, header, quantity = min(found)
    labels = [plain_key(c) for at, cells in head if at <= header for c in cells]
    coded = any("номенклатура" in x and ("артикул" in x or "код" in x) for x in labels) or "номенклатура" not in labels
    body = rows.filter(F.col("row") > header)
    deepest = body.agg(F.max(F.when(F.col("level") > 0, F.col("level"))).alias("leaf"))
    if deepest.filter("leaf is not null").isEmpty():
        raise MissingColumn("the report's rows have no outline levels")
    filled = F.filter(F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")), lambda c: c != "")
    leaves = body.join(F.broadcast(deepest), F.col("level") == F.col("leaf")).select("row", F.coalesce(F.get(filled, F.lit(0)), F.lit("")).alias("label"), Sheet.number(quantity).alias("units"))
    split = F.regexp_extract("label", r"(?s)^(.*),([^,]*)$", 1), F.regexp_extract("label", r"(?s)^(.*),([^,]*)$", 2)
    has = F.col("label").contains(",") if coded else F.lit(False)
    made = leaves.select("row", F.when(has, F.nullif(F.trim(split[1]), F.lit(""))).alias("sku"), F.trim(F.when(has, split[0]).otherwise(F.col("label"))).alias("product_name"), F.lit(month).alias("month"), "units")
    return made.filter("product_name <> '' and units is not null")


def grouped_totals(rows: DataFrame) -> DataFrame:
    """sku, product_name (the first), month and units of ``grouped`` rows with a SKU."""
    return rows.filter("sku is not null").groupBy("sku", "month").agg(F.min_by("product_name", "row").alias("product_name"), F.sum("units").alias("units")).select("sku", "product_name", "month", "units")


def inbound(rows: DataFrame) -> DataFrame:
    """One row a SKU and arrival column with a quantity; the date comes from the column's name, else null."""
    sheet = Sheet(rows, SKU, NAME)
    sku, name = sheet.need(SKU, "SKU"), sheet.need(NAME, "name")
    due = re.compile(r"поступлени[ея]\s+до(?:\s+(\d{1,2})\.(\d{1,2})\.(\d{4}))?", re.IGNORECASE)
    columns = []
    for k, label in enumerate(sheet.labels):
        found = due.search(label or "")
        if found or " в пути " in f" {sheet.keys[k]} ":
            date = f"{found[3]}-{int(found[2]):02d}-{int(found[1]):02d}" if found and found[3] else None
            columns.append(F.struct(F.lit((label or "").strip()).alias("shipment_id"), F.lit(date).cast("string").alias("expected_date"), sheet.number(k).alias("quantity")))
    if not columns:
        raise MissingColumn("no inbound columns were found")
    made = sheet.body.select(sheet.text(sku).alias("sku"), sheet.text(name).alias("product_name"), F.explode(F.array(*columns)).alias("c"))
    return made.select("sku", "product_name", "c.*").filter("sku <> '' and quantity <> 0")


def _pair(rows: DataFrame, sku_names: Sequence[str], names: Sequence[str], out: str, loose: bool = False) -> DataFrame:
    sheet = Sheet(rows, sku_names, names)
    sku = sheet.need(sku_names, "SKU")
    k = next(iter(sheet.where(lambda k: any(n in sheet.keys[k] for n in names))), None) if loose else sheet.find(names)
    if k is None:
        raise MissingColumn(f"required column was not found: {out}")
    return sheet.body.select("row", sheet.text(sku).alias("sku"), sheet.number(k).alias(out)).filter(F.col(out).isNotNull() & (F.col("sku") != ""))


def multiples(rows: DataFrame) -> DataFrame:
    return _pair(rows, SKU, MULTIPLE, "multiple").filter("multiple > 0")


def reservations(rows: DataFrame) -> DataFrame:
    return _pair(rows, ("код 1с",), ("зарезервировано",), "reserved_stock").withColumn("reserved_stock", F.greatest(F.lit(0.0), "reserved_stock"))


def current_stock(rows: DataFrame) -> DataFrame:
    return _pair(rows, ("код 1с",), ("остаток",), "current_stock").withColumn("current_stock", F.greatest(F.lit(0.0), "current_stock"))


def cost_prices(rows: DataFrame) -> DataFrame:
    return _pair(rows, ("код 1с",), ("сс реал",), "cost_price", loose=True).filter("cost_price > 0")


def categories(rows: DataFrame) -> DataFrame:
    sheet = Sheet(rows, ("код 1с",), ("категория",))
    k = next(iter(sheet.where(lambda k: re.fullmatch(r"категория(?: 20\d{2})?", sheet.keys[k]) is not None)), None)
    if k is None:
        raise MissingColumn("required column was not found: category")
    return sheet.body.select("row", sheet.text(sheet.need(("код 1с",), "SKU")).alias("sku"), sheet.text(k).alias("category")).filter("sku <> '' and category <> ''")


def _percent(value: Column) -> Column:
    """Shares from 0 to 1 as percent; larger figures are percent already."""
    return F.when(value.between(0, 1), value * 100).otherwise(value)


def batches_flat(rows: DataFrame) -> DataFrame:
    """One row a lot.  A status that is no number marks the lot as expired."""
    sheet = Sheet(rows, SKU, QUANTITY)
    sku, quantity = sheet.need(SKU, "SKU"), sheet.need(QUANTITY, "quantity")
    status = sheet.find(EXPIRY_STATUS)
    made = sheet.body.select(
        sheet.text(sku).alias("sku"),
        F.nullif(sheet.text(sheet.find(WAREHOUSE)), F.lit("")).alias("warehouse"),
        sheet.number(quantity).alias("quantity"),
        _percent(sheet.number(sheet.find(SHELF_LIFE))).alias("shelf_life_percent"),
        (sheet.number(status).isNull() & (sheet.text(status) != "")).alias("expired"),
    )
    return made.filter("sku <> '' and quantity > 0")


def batches_matrix(rows: DataFrame, today: str) -> DataFrame:
    """One row a SKU and warehouse column; expired if its date lies before ``today``."""
    sheet = Sheet(rows, SKU, ("склад",))
    sku = sheet.need(SKU, "SKU")
    columns = sheet.where(lambda k: "склад" in sheet.keys[k].split(" "))
    if not columns:
        raise MissingColumn("required column was not found: warehouses")
    day = F.regexp_replace(sheet.text(sheet.find(EXPIRY_DATE)), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2})$", "$1.$2.20$3")
    stock = F.array(*[F.struct(F.lit((sheet.labels[k] or "").strip()).alias("warehouse"), sheet.number(k).alias("quantity")) for k in columns])
    expired = F.coalesce(moment(day).cast("date") < F.lit(today).cast("date"), F.lit(False))
    made = sheet.body.select(sheet.text(sku).alias("sku"), F.explode(stock).alias("c"), _percent(sheet.number(sheet.find(SHELF_LIFE))).alias("shelf_life_percent"), expired.alias("expired"))
    return made.select("sku", "c.*", "shelf_life_percent", "expired").filter("sku <> '' and quantity > 0")


def batches(rows: DataFrame, today: str) -> DataFrame:
    """The flat form, else the matrix."""
    try:
        return batches_flat(rows)
    except MissingColumn:
        return batches_matrix(rows, today)


def first_sheet(book: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``parse`` of the first sheet of one workbook whose structure it accepts."""
    for r in book.select("sheet_no").distinct().orderBy("sheet_no").collect():
        try:
            return parse(book.filter(F.col("sheet_no") == r["sheet_no"]))
        except MissingColumn:
            continue
    raise MissingColumn("no sheet has the required columns")


def optional(books: Sequence[DataFrame], parse: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """All workbooks that have the columns, with ``file_rank`` so that later files win."""
    found = None
    for rank, book in enumerate(books):
        try:
            one = first_sheet(book, parse).withColumn("file_rank", F.lit(rank))
        except MissingColumn:
            continue
        found = one if found is None else found.unionByName(one)
    return found
