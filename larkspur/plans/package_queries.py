"""Review packages of scenarios as a query, with their DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import kept, shared_dir
from larkspur.plans import views as V
from larkspur.plans.decision_queries import _GRID, FEWER_ORDERS
from larkspur.sources import packages as P
from larkspur.sources.stores import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _packages(s: SparkSession, d: str) -> DataFrame:
    """All packages, written, verified and read back beside their status."""
    baselines = V.customers(s, d).select("customer_id", "n_orders", "spent", "balance")
    made = kept(P.packages(baselines, FEWER_ORDERS, "customer_id", 20, F.concat(F.lit("c-"), F.col("customer_id").cast("string")), digits=2))
    path = f"{shared_dir(s).rstrip('/')}/packages-{uuid.uuid4().hex}"
    try:
        P.write_packages(made, path)
        read = s.read.option("lineSep", "\n").text(path).select(F.get_json_object("value", "$.validatedArtifactHash").alias("hash"), F.col("value").alias("package"))
        rows = made.select("customer_id", "status", F.concat(F.lit("c-"), F.col("customer_id").cast("string")).alias("hash")).join(read, "hash", "left")
        return kept(rows.select("customer_id", "status", "package"))
    finally:
        Store(s, path).delete(path)


QUERIES["scenario_packages"] = _packages


def _n(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _r(x: str) -> str:
    return _n(f"round({x}, 2)")


def _impact(name: str, before: str, after: str) -> str:
    return f"""'{{"absoluteChange":' || {_r(f"({after} - {before})")} || ',"baselineValue":' || {_r(before)} || ',"metric":"{name}","relativeChangePct":' || {_r(f"(CASE WHEN {before} <> 0 THEN ({after} - {before}) / abs({before}) * 100 END)")} || ',"simulatedValue":' || {_r(after)} || '}}'"""


_STEP = f"""'{{"baselineValue":' || {_r("n_orders")} || ',"bounded":' || CASE WHEN s1 <> free THEN 'true' ELSE 'false' END || ',"changePct":' || {_n("change_pct")} || ',"effectiveChangePct":' || {_r("(CASE WHEN n_orders <> 0 THEN (n1 - n_orders) / abs(n_orders) * 100 END)")} || ',"impacts":[' || {_impact("spent", "spent", "s1")} || ',' || {_impact("balance", "balance", "b1")}
  || '],"reachesTarget":' || CASE WHEN s1 <= 500000 THEN 'true' ELSE 'false' END || ',"requestedUnboundedValue":' || {_r("n1")} || ',"scenarioValue":' || {_r("n1")} || ',"targetValue":' || {_r("s1")} || '}}'"""
_EFFECT = '{{"effectCoefficient":{0},"provenance":{{"kind":"configured_assumption","note":"worked example"}},"sourceMetric":"{1}","targetMetric":"{2}"}}'
SQL["scenario_packages"] = f"""{_GRID}, steps AS (SELECT *, {_STEP} AS step FROM c WHERE ok),
p AS (SELECT customer_id, string_agg(step, ',' ORDER BY change_pct) AS steps, max(CASE WHEN change_pct = 20 THEN step END) AS asked, arg_min(step, change_pct) FILTER (s1 <= 500000) AS least, {_r("any_value(n_orders)")} AS latest FROM steps GROUP BY 1)
SELECT customer_id, CASE WHEN p.asked IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status, '{{"assumptions":{{"kind":"MODEL_ASSUMPTION","relationships":[{_EFFECT.format(100000, "n_orders", "spent")},{_EFFECT.format(0.01, "spent", "balance")}]}},"disclaimer":"{P.DISCLAIMER}","format":"MODEL_REVIEW_PACKAGE","intervention":{{"candidates":[' || steps || '],"controlMetric":"n_orders","kind":"INTERVENTION_ANALYSIS","recommendedCandidate":' || coalesce(least, 'null')
  || ',"status":"' || CASE WHEN least IS NULL THEN 'TARGET_NOT_REACHED' ELSE 'TARGET_REACHED' END || '","targetMetric":"spent","targetThreshold":500000}},"observed":{{"kind":"OBSERVED","latestValue":' || latest || ',"target":"spent"}},"scenario":{{"controlMetric":"n_orders","kind":"SIMULATION","result":' || asked || '}},"validatedArtifactHash":"c-' || customer_id || '"}}' AS package
FROM customers LEFT JOIN p USING (customer_id)"""
