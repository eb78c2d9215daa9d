"""The driver's tables presented as the engine's relations.

Derivations use plain arithmetic on keys so that SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import let

AS_OF = "2000-12"
#: The first instant after ``AS_OF``, for filters that reach the scan.
AFTER = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quantity() -> Column:
    """Sales quantities in which large orders, growth and decline occur.

    Some orders are sixteen times as large; some suppliers have many of these in the
    last three months, others sell next to nothing then.
    """
    s, late = F.col("l_suppkey") % 77, (F.col("l_shipdate") >= F.lit("2000-10-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(AFTER).cast("timestamp_ntz"))
    factor = F.when(late & (s % 11 == 5), 0.0625).when(late & (s % 11 == 6), 0.25).when(late & (s % 7 == 3) & (F.col("l_orderkey") % 4 == 0), 16.0).when(F.col("l_orderkey") % 61 == 0, 16.0).otherwise(1.0)
    return F.col("l_quantity") * factor


def transactions(spark: SparkSession, sf_dir: str, grain: str = "p_type") -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(grain).alias("sku"), F.col("p_name").alias("product_name"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("supplier"),
        "sku",
        F.col("l_shipdate").alias("occurred_at"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_orderkey").cast("string")).alias("invoice_number"),
        _quantity().alias("units_sold"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey").alias("row_order"),
        "product_name",
    )


def monthly(spark: SparkSession, sf_dir: str, grain: str = "p_type", filled: bool = False) -> DataFrame:
    sums = transactions(spark, sf_dir, grain).groupBy("supplier", "sku", "month").agg(F.sum("units_sold").alias("units_sold"))
    if not filled:
        return sums
    first = F.to_date(F.concat(F.min("month"), F.lit("-01")))
    months = sums.groupBy("supplier", "sku").agg(first.alias("a")).filter(F.col("a") <= F.lit(f"{AS_OF}-01").cast("date"))
    every = months.select("supplier", "sku", F.explode(F.sequence("a", F.lit(f"{AS_OF}-01").cast("date"), F.expr("interval 1 month"))).alias("d")).select("supplier", "sku", F.date_format("d", "yyyy-MM").alias("month"))
    return every.join(sums, ["supplier", "sku", "month"], "left").fillna(0.0, ["units_sold"])


def series(spark: SparkSession, sf_dir: str, grain: str = "p_type") -> DataFrame:
    return transactions(spark, sf_dir, grain).filter(F.col("month") <= AS_OF).select("supplier", "sku").distinct()


def opening(monthly_sales: DataFrame) -> DataFrame:
    value = opening_stock(F.col("supplier"), F.col("sku"), F.col("month"))
    return monthly_sales.select("supplier", "sku", "month", value.alias("opening_stock"), F.lit(1).alias("row_order"))


def opening_stock(supplier: Column, sku: Column, month: Column) -> Column:
    months = F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")
    return F.greatest(F.lit(0), F.pmod(supplier.cast("int") * 7 + months * 13 + F.length(sku) * 3, F.lit(50)) - 12).cast("double")


def with_opening(months: DataFrame, filled: bool = False) -> DataFrame:
    """``m`` with opening balances, and their list ``stocks``; row-wise.

    Filled series have every month from their first to ``AS_OF``.
    """
    m = F.col("m")
    if filled:
        day = lambda month: F.to_date(F.concat(month, F.lit("-01")))
        every = F.sequence(day(F.get(m, F.lit(0))["month"]), day(F.lit(AS_OF)), F.expr("interval 1 month"))
        by_name = F.map_from_entries(F.transform(m, lambda x: F.struct(x["month"], x)))

        def of_month(known: Column, name: Column) -> Column:
            x = F.try_element_at(known, name)
            return F.struct(name.alias("month"), F.coalesce(x["sold"], F.lit(0.0)).alias("sold"), F.coalesce(x["units"], F.lit(0.0)).alias("units"))

        months = months.withColumn("m", let(by_name, lambda known: F.transform(F.transform(every, lambda d: F.date_format(d, "yyyy-MM")), lambda name: of_month(known, name))))
    stocked = F.transform("m", lambda x: F.struct(x["month"].alias("month"), x["sold"].alias("sold"), x["units"].alias("units"), opening_stock(F.col("supplier"), F.col("sku"), x["month"]).alias("opening_stock")))
    return months.withColumn("m", stocked).withColumn("stocks", F.transform("m", lambda x: F.struct(x["month"].alias("month"), x["opening_stock"].alias("opening_stock"))))


def with_dimensions(series_rows: DataFrame) -> DataFrame:
    """The columns of config, snapshot, reserved and multiples on rows of series."""
    s = F.col("supplier").cast("int")
    return series_rows.withColumns(
        {
            "category": F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), s % 3 + 1),
            "forecast_growth_rate": (s % 5).cast("double") * 0.02,
            "lead_time_months": F.when(s % 5 == 0, 1.5),
            "current_stock": F.when(s % 3 == 0, F.pmod(s * 31 + F.length("sku") * 17, F.lit(400)).cast("double")),
            "excluded_for_shelf_life": F.when(s % 6 == 0, 5.0),
            "reserved_stock": F.when(s % 4 == 0, F.pmod(s * 3, F.lit(20)).cast("double")),
            "multiple": F.when(s % 2 == 0, 10.0 * (1 + s % 5)),
        }
    )


def config(skus: DataFrame) -> DataFrame:
    s = F.col("supplier").cast("int")
    return skus.select(
        "supplier",
        "sku",
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), s % 3 + 1).alias("category"),
        ((s % 5).cast("double") * 0.02).alias("forecast_growth_rate"),
        F.when(s % 5 == 0, 1.5).alias("lead_time_months"),
    )


def snapshot(skus: DataFrame) -> DataFrame:
    s = F.col("supplier").cast("int")
    return skus.filter(s % 3 == 0).select("supplier", "sku", F.pmod(s * 31 + F.length("sku") * 17, F.lit(400)).cast("double").alias("current_stock"), F.when(s % 6 == 0, 5.0).otherwise(0.0).alias("excluded_for_shelf_life"), F.lit(1).alias("row_order"))


def reserved(skus: DataFrame) -> DataFrame:
    s = F.col("supplier").cast("int")
    return skus.filter(s % 4 == 0).select("supplier", "sku", F.pmod(s * 3, F.lit(20)).cast("double").alias("reserved_stock"), F.lit(1).alias("row_order"))


def multiples(skus: DataFrame) -> DataFrame:
    s = F.col("supplier").cast("int")
    return skus.filter(s % 2 == 0).select("supplier", "sku", (10.0 * (1 + s % 5)).alias("multiple"), F.lit(1).alias("row_order"))


def inbound(spark: SparkSession, sf_dir: str, grain: str = "p_type") -> DataFrame:
    later = transactions(spark, sf_dir, grain).filter(F.col("occurred_at") >= F.lit(AFTER).cast("timestamp_ntz"))
    eta = F.when(F.col("row_order.l_linenumber") == 7, F.lit(None)).otherwise(F.to_date("occurred_at"))
    return later.select("supplier", "sku", eta.alias("expected_date"), F.col("units_sold").alias("quantity"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("sku"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linenumber")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").cast("string").alias("supplier"),
        "sku",
        F.when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.col("n_name")).alias("warehouse"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_discount") * 1000, 3).alias("shelf_life_percent"),
        (F.col("l_returnflag") == "R").alias("expired"),
    )


def event_log(spark: SparkSession, sf_dir: str, entity: str = "user_id") -> DataFrame:
    """event_id, entity_id, micros, event_type, value, source_row.

    Time runs sixty times as fast, a few events are of a rare type, values come in
    steps and some lie far out, so that bursts, repeats and outliers occur.
    """
    rare = F.when(F.col("event_id") % 50 == 7, "manual_review").otherwise(F.col("event_type"))
    value = F.floor(F.col("value") / 50) * 50.0 + F.when(F.col("event_id") % 97 == 5, 100000.0).otherwise(0.0)
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col(entity).cast("string").alias("entity_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long").alias("micros"), rare.alias("event_type"), value.alias("value"), F.col("event_id").alias("source_row"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer: segment, region, balance and order figures."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.countDistinct("o_orderpriority").cast("double").alias("priorities"))
    base = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return base.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"), "n_orders", "spent", "priorities")


#: Numeric columns of ``weekly``, in their order.
WEEKLY = ("n_orders", "revenue", "mean_price", "urgent", "finished", "customers")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly series of order figures with a running row number from 0."""
    week = F.date_trunc("week", "o_orderdate")
    sums = table(spark, sf_dir, "orders").groupBy(week.cast("date").alias("week")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        # An exact sum, so that any order of adding gives the same mean.
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean_price"),
        F.count_if(F.col("o_orderpriority").startswith("1")).cast("double").alias("urgent"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("finished"),
        F.countDistinct("o_custkey").cast("double").alias("customers"),
    )
    return sums


SQL = f"""
tx AS (SELECT CAST(l_suppkey AS VARCHAR) AS supplier, CAST(l_suppkey AS INTEGER) AS s, {{grain}} AS sku, l_shipdate AS occurred_at,
    strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS invoice_number,
    l_quantity * CASE WHEN l_shipdate >= TIMESTAMP '2000-10-01' AND l_shipdate < TIMESTAMP '{AFTER}' AND l_suppkey % 77 % 11 = 5 THEN CAST(0.0625 AS DOUBLE) WHEN l_shipdate >= TIMESTAMP '2000-10-01' AND l_shipdate < TIMESTAMP '{AFTER}' AND l_suppkey % 77 % 11 = 6 THEN 0.25
      WHEN l_shipdate >= TIMESTAMP '2000-10-01' AND l_shipdate < TIMESTAMP '{AFTER}' AND l_suppkey % 77 % 7 = 3 AND l_orderkey % 4 = 0 THEN 16 WHEN l_orderkey % 61 = 0 THEN 16 ELSE 1 END AS units_sold, l_orderkey, l_linenumber, l_partkey, l_shipdate, p_name AS product_name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sums AS (SELECT supplier, s, sku, month, sum(units_sold) AS units_sold FROM tx GROUP BY ALL),
monthly AS ({{monthly}}),
skus AS (SELECT DISTINCT supplier, s, sku FROM tx WHERE month <= '{AS_OF}'),
opening AS (SELECT supplier, sku, month, CAST(greatest(0, (s * 7 + (CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER)) * 13 + length(sku) * 3) % 50 - 12) AS DOUBLE) AS opening_stock FROM monthly),
config AS (SELECT supplier, s, sku, ['A', 'B', 'C'][s % 3 + 1] AS category, CAST(s % 5 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS forecast_growth_rate, CASE WHEN s % 5 = 0 THEN CAST(1.5 AS DOUBLE) END AS lead_time_months FROM skus),
snapshot AS (SELECT supplier, sku, CAST((s * 31 + length(sku) * 17) % 400 AS DOUBLE) AS current_stock, CAST(CASE WHEN s % 6 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS excluded FROM skus WHERE s % 3 = 0),
reserved AS (SELECT supplier, sku, CAST((s * 3) % 20 AS DOUBLE) AS reserved_stock FROM skus WHERE s % 4 = 0),
multiples AS (SELECT supplier, sku, CAST(10 * (1 + s % 5) AS DOUBLE) AS multiple FROM skus WHERE s % 2 = 0),
inbound AS (SELECT supplier, sku, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(occurred_at AS DATE) END AS eta, units_sold AS quantity FROM tx WHERE month > '{AS_OF}')"""

_FILLED = f"""SELECT b.supplier, b.s, b.sku, b.month, coalesce(sums.units_sold, 0) AS units_sold FROM (
  SELECT supplier, s, sku, strftime(unnest(generate_series(a, TIMESTAMP '{AS_OF}-01', INTERVAL 1 MONTH)), '%Y-%m') AS month
  FROM (SELECT supplier, s, sku, CAST(min(month) || '-01' AS TIMESTAMP) AS a FROM sums GROUP BY ALL HAVING min(month) <= '{AS_OF}')) b
  LEFT JOIN sums ON b.supplier = sums.supplier AND b.sku = sums.sku AND b.month = sums.month"""


def facts_sql(grain: str = "p_type", filled: bool = False) -> str:
    return SQL.format(grain=grain, monthly=_FILLED if filled else "SELECT * FROM sums")


CUSTOMERS_SQL = """
orders_of AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, round(sum(o_totalprice), 2) AS spent, CAST(count(DISTINCT o_orderpriority) AS DOUBLE) AS priorities FROM orders GROUP BY 1),
customers AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, r_name AS region, c_acctbal AS balance, n_orders, spent, priorities
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders_of ON c_custkey = o_custkey)"""

WEEKLY_SQL = """
weeks AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(count(*) AS DOUBLE) AS n_orders, round(sum(o_totalprice), 2) AS revenue,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price, CAST(count(*) FILTER (o_orderpriority LIKE '1%') AS DOUBLE) AS urgent,
    CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS finished, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customers
  FROM orders GROUP BY 1),
weekly AS (SELECT *, row_number() OVER (ORDER BY week) - 1 AS idx, count(*) OVER () AS n_rows FROM weeks),
long AS (UNPIVOT (SELECT idx, n_rows, n_orders, revenue, mean_price, urgent, finished, customers FROM weekly) ON n_orders, revenue, mean_price, urgent, finished, customers INTO NAME signal VALUE x)"""
EVENTS_SQL = """
log AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST({entity} AS VARCHAR) AS entity_id, epoch_us(ts) // 60 AS micros, CASE WHEN event_id % 50 = 7 THEN 'manual_review' ELSE event_type END AS event_type, floor(value / 50) * 50 + CASE WHEN event_id % 97 = 5 THEN 100000 ELSE 0 END AS value, event_id AS source_row FROM events)"""
