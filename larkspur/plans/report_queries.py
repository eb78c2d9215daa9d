"""Report sheets made from the driver's tables and parsed, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans import views as V
from larkspur.sources import reports as R
from larkspur.sources import suppliers as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

YEAR = 2000
_LABELS = [f"{names[0]} {YEAR}" for names in R.MONTHS]
_MONTHS = [f"{YEAR}-{k:02d}" for k in range(1, 13)]


def _sheet(s: SparkSession, header: list[str], body: DataFrame, *cells: Column) -> DataFrame:
    """row and cells: the header, and a row for each of ``body``."""
    top = s.createDataFrame([(1, 0, header)], "row int, level int, cells array<string>")
    return top.unionByName(body.select(F.lit(2).alias("row"), F.lit(2).alias("level"), F.array(*[c.cast("string") for c in cells]).alias("cells")))


def _sales(s: SparkSession, d: str) -> DataFrame:
    return V.transactions(s, d).filter((F.col("occurred_at") >= F.lit(f"{YEAR}-01-01").cast("timestamp_ntz")) & (F.col("occurred_at") < F.lit(f"{YEAR + 1}-01-01").cast("timestamp_ntz")))


def _wide(s: SparkSession, d: str) -> DataFrame:
    months = _sales(s, d).groupBy("sku").pivot("month", _MONTHS).agg(F.sum("units_sold"))
    return R.monthly(_sheet(s, ["Код", "Номенклатура", *_LABELS], months, F.col("sku"), F.concat(F.lit("Goods "), "sku"), *[F.col(m) for m in _MONTHS]))


def _long(s: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, _LABELS)), F.substring("month", 6, 2).cast("int"))
    return R.monthly(_sheet(s, ["Код", "Номенклатура", "Месяц", "Количество"], _sales(s, d), F.col("sku"), F.concat(F.lit("Goods "), "sku"), label, F.col("units_sold")))


def _grouped(s: SparkSession, d: str) -> DataFrame:
    march = _sales(s, d).filter(f"month = '{YEAR}-03'")
    sheet = _sheet(s, [f"Период: 01.03.{YEAR} - 31.03.{YEAR}", "Номенклатура, Код", "Количество"], march, F.concat(F.lit("Goods, of, "), "sku"), F.lit(None), F.col("units_sold"))
    return R.grouped_totals(R.grouped(sheet))


_SUMS = f"WITH {V.facts_sql()}, s AS (SELECT sku, month, sum(units_sold) AS value FROM tx WHERE month BETWEEN '{YEAR}-01' AND '{YEAR}-12' GROUP BY ALL)"
QUERIES["parse_monthly_wide"] = lambda s, d: _wide(s, d).select("sku", "product_name", "month", F.round("value", 4).alias("value"))
SQL["parse_monthly_wide"] = f"{_SUMS}, k AS (SELECT DISTINCT sku FROM s) SELECT k.sku, 'Goods ' || k.sku AS product_name, m.month, round(coalesce(value, 0), 4) AS value FROM k CROSS JOIN (SELECT unnest({_MONTHS}) AS month) m LEFT JOIN s ON s.sku = k.sku AND s.month = m.month"
QUERIES["parse_monthly_long"] = lambda s, d: _long(s, d).select("sku", "product_name", "month", F.round("value", 4).alias("value"))
SQL["parse_monthly_long"] = f"{_SUMS} SELECT sku, 'Goods ' || sku AS product_name, month, round(value, 4) AS value FROM s"
QUERIES["aggregate_grouped_report"] = lambda s, d: _grouped(s, d).select("sku", "product_name", "month", F.round("units", 4).alias("units"))
SQL["aggregate_grouped_report"] = f"{_SUMS} SELECT sku, 'Goods, of' AS product_name, month, round(value, 4) AS units FROM s WHERE month = '{YEAR}-03'"


def _matrix(s: SparkSession, d: str) -> DataFrame:
    parts = V.table(s, d, "part")
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")), "dd.MM.yyyy")
    sheet = _sheet(s, ["Код", "Срок годности", "Склад North", "Склад South"], parts, F.col("p_partkey"), day, F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")), F.col("p_partkey") % 7 + 1)
    return R.batches_matrix(sheet, "2000-01-20")


QUERIES["parse_stock_batches_matrix"] = lambda s, d: _matrix(s, d).select("sku", "warehouse", F.round("quantity", 4).alias("quantity"), "expired")
SQL["parse_stock_batches_matrix"] = """WITH b AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, DATE '2000-01-01' + p_size AS day, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS north, CAST(p_partkey % 7 + 1 AS DOUBLE) AS south FROM part)
SELECT sku, 'Склад North' AS warehouse, north AS quantity, day < DATE '2000-01-20' AS expired FROM b WHERE north <> 0 UNION ALL SELECT sku, 'Склад South', south, day < DATE '2000-01-20' FROM b"""


def _union(s: SparkSession, d: str) -> DataFrame:
    """Sales of two suppliers' relations under one plan; one of them has no inbound."""
    sales = V.monthly(s, d)
    one = {"monthly": sales.filter("supplier = '1'"), "inbound": V.inbound(s, d).filter("supplier = '1'")}
    both = S.union([one, {"monthly": sales.filter("supplier = '2'")}])
    return both["monthly"].groupBy("supplier").agg(F.count(F.lit(1)).cast("bigint").alias("months"), F.round(F.sum("units_sold"), 4).alias("units"))


QUERIES["union_suppliers"] = _union
SQL["union_suppliers"] = f"WITH {V.facts_sql()} SELECT supplier, CAST(count(*) AS BIGINT) AS months, round(sum(units_sold), 4) AS units FROM monthly WHERE supplier IN ('1', '2') GROUP BY 1"
QUERIES["supplier_keys"] = lambda s, d: S.supplier_keys(V.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("Завод  №"), (F.col("s_suppkey") % 7).cast("string")).alias("name")), "s_suppkey").select("key")
SQL["supplier_keys"] = "SELECT 'zavod-' || m || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS key FROM (SELECT s_suppkey % 7 AS m, row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) AS k FROM supplier)"
