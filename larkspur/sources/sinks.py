"""Order files, share links and verified decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import formula_guard, url_component
from larkspur.operators.validation import fingerprint

#: The header of a supplier's order file, without a product name.
ORDER_HEADER = ("Поставщик", "SKU", "Наименование", "Рекомендация", "Подтверждено менеджером", "Срочность", "Расчёт на")


#: The header of the file of all confirmed orders.
ORDERS_HEADER = ("Поставщик", "SKU", "Наименование", "Рекомендация", "Подтверждено", "Срочность")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _number(c: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def csv_line(*cells: Column, sep: str = ";") -> Column:
    return F.concat_ws(sep, *[_quoted(c) for c in cells])


def supplier_lines(lines: DataFrame, as_of: str) -> DataFrame:
    """supplier, position, line: a header (position 0) and the lines with a quantity, by SKU.

    Columns of ``lines``: supplier, sku, product_name, recommended, quantity, urgency.
    """
    kept = lines.filter("quantity > 0")
    cells = [formula_guard(F.col("supplier")), formula_guard(F.col("sku")), formula_guard(F.col("product_name")), _number(F.col("recommended")), _number(F.col("quantity")), formula_guard(F.col("urgency")), F.lit(as_of)]
    body = kept.select("supplier", F.lit(1).alias("position"), "sku", csv_line(*cells).alias("line"))
    head = F.concat(F.lit("﻿"), csv_line(*[F.lit(h) for h in ORDER_HEADER]))
    top = kept.select("supplier").distinct().select("supplier", F.lit(0).alias("position"), F.lit("").alias("sku"), head.alias("line"))
    return top.unionByName(body)


def write_orders(lines: DataFrame, as_of: str, path: str) -> None:
    """A folder a supplier.  Its part files, joined in the order of their names, are the order file.

    Rows are dealt by range, so a supplier with many lines spans several tasks.
    """
    ready = supplier_lines(lines, as_of).withColumn("folder", F.col("supplier"))
    order = ["folder", "position", "sku", "line"]
    dealt = ready.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("folder", "line").write.partitionBy("folder").option("lineSep", "\r\n").mode("overwrite").text(path)


def write_all_orders(lines: DataFrame, path: str) -> None:
    """Confirmed lines of all suppliers; the part files in order of their names are the file."""
    cells = [F.col("supplier"), F.col("sku"), F.col("product_name"), _number(F.col("recommended")), _number(F.col("quantity")), F.col("urgency")]
    body = lines.filter("quantity > 0").select(F.lit(1).alias("position"), "supplier", "sku", csv_line(*[formula_guard(c) for c in cells]).alias("line"))
    head = F.concat(F.lit("\ufeff"), csv_line(*[F.lit(h) for h in ORDERS_HEADER]))
    top = lines.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit("").alias("supplier"), F.lit("").alias("sku"), head.alias("line"))
    order = ["position", "supplier", "sku", "line"]
    dealt = top.unionByName(body).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("line").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def share_urls(message: Column, source_url: str = "") -> tuple[Column, Column]:
    """WhatsApp and Telegram links that carry a message; the second encodes a form, spaces as '+'."""
    whatsapp = F.concat(F.lit("https://wa.me/?text="), url_component(message))
    telegram = F.concat(F.lit("https://t.me/share/url?url="), F.url_encode(F.lit(source_url)), F.lit("&text="), F.url_encode(message))
    return whatsapp, telegram


def write_verified(df: DataFrame, path: str, kind: str = "json") -> dict[str, object]:
    """Write rows, read them back and compare counts and fingerprints; raises where they differ."""
    before = fingerprint(df)
    df.write.mode("overwrite").format(kind).save(path)
    after = fingerprint(df.sparkSession.read.schema(df.schema).format(kind).load(path))
    if before != after:
        raise ValueError(f"rows read back differ: {before} written, {after} read")
    return before
