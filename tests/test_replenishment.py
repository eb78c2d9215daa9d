"""Queries against their DuckDB twins on the smallest tables, and golden rules."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import replenishment as R
from larkspur.plans import replenishment_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def rows_of(columns, rows):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return round(x, 5) + 0.0 if isinstance(x, float) else x if isinstance(x, (int, bool, str)) else str(x)[:10]

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["monthly_aggregate", "spike_threshold", "recommended_order", "exceptions", "batch_aggregate", "deadline_buckets", "scoped_lookup_left", "order_message_lines"])
def test_twin(spark, oracle, name):
    got = Q.QUERIES[name](spark, SF)
    want = oracle.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_every_twin_parses(oracle):
    for sql in Q.SQL.values():
        oracle.execute("EXPLAIN " + sql)


def test_z_scores(spark):
    levels = [0.5, 0.9, 0.925, 0.98, 0.999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in levels], "x double").select(C.z_score(F.col("x"))).collect()]
    assert got == pytest.approx([1.2816, 1.2816, 1.46325, 2.0537, 2.5758])


def test_numeric_cell(spark):
    cells = ["1 500", "1 500.5", "", None, "NaN", "0x10", "1d", "-2e3"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in cells], "x string").select(C.numeric_cell(F.col("x"))).collect()]
    assert got == [1500.0, 1500.5, None, None, None, None, None, -2000.0]


def test_last_row_wins(spark):
    dim = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "x", 2.0, 3), ("a", "x", 9.0, 2)], "supplier string, sku string, v double, row_order int")
    assert [tuple(r) for r in R.last_wins(dim, "row_order").collect()] == [("a", "x", 2.0)]


def test_options_are_checked():
    with pytest.raises(ValueError):
        R.Options(lead_time=0).validate()


@pytest.mark.parametrize("name", ["batch_over_snapshot", "batch_over_snapshot_all"])
def test_twins_of_batch_stock(spark, oracle, name):
    test_twin(spark, oracle, name)


def test_batch_stock_counts_every_batch_and_falls_back_to_snapshots(spark):
    rows = [("a", "x", "w", 5.0, 95.0, False), ("a", "x", "w", 7.0, 40.0, False), ("a", "x", None, 1.0, None, False), ("a", "x", "v", 100.0, 10.0, False), ("a", "low", "w", 3.0, 50.0, False), ("a", "gone", "w", 9.0, 99.0, True)]
    batches = spark.createDataFrame(rows, "supplier string, sku string, warehouse string, quantity double, shelf_life_percent double, expired boolean")
    snapshot = spark.createDataFrame([("a", sku, 1000.0) for sku in ("x", "low", "gone", "rest")], "supplier string, sku string, current_stock double")
    got = {r.sku: r.current_stock for r in R.batch_over_snapshot(R.batch_stock(batches, 30.0), snapshot).collect()}
    assert got == {"x": 13.0, "low": 3.0, "gone": 0.0, "rest": 1000.0}


def test_forecast_is_not_written_out_in_a_filter(spark):
    plan = Q.QUERIES["seasonal_forecast"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line) < 2_000


def test_forecast_against_its_twin(spark, oracle):
    test_twin(spark, oracle, "seasonal_forecast")


def test_forecast_rounds_ties_as_its_twin(spark, tmp_path):
    # January's share, 10.171875 of 10, is 1.0171875 as text; its millionfold is 1017187.4999999999 in doubles.
    units = [10.171875, *[10.0] * 10, 9.828125]
    rows = [(k, 1, 1, 1, x, f"2000-{k:02d}-15 00:00:00") for k, x in enumerate(units, 1)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, day string")
    items.withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "pin", "SMALL", "B")], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = Q.QUERIES["seasonal_forecast"](spark, str(tmp_path)).collect()
    twin = duckdb.connect()
    for name in ("lineitem", "part"):
        twin.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(twin.execute(Q.SQL["seasonal_forecast"]).fetchall())
    assert {r.month: r.season_index for r in got} == {"2001-01": 1.017187, "2001-02": 1.0, "2001-03": 1.0}
