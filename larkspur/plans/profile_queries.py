"""Queries on profiles, shapes, schemas and summaries, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import bounded_ids
from larkspur.operators import events as E
from larkspur.operators import profile as P
from larkspur.plans import investigation_queries as Q
from larkspur.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- column and table profiles ----------------------------------------------

COLUMNS = ("segment", "region", "balance", "n_orders", "spent", "priorities", "debt", "land")


def _table(s: SparkSession, d: str) -> DataFrame:
    """Customers with a truth value and a constant."""
    return V.customers(s, d).withColumns({"debt": F.when(F.col("balance") < 0, "true").otherwise("false"), "land": F.lit("here")})


_T = f"WITH {V.CUSTOMERS_SQL}, t AS (SELECT *, CASE WHEN balance < 0 THEN 'true' ELSE 'false' END AS debt, 'here' AS land FROM customers), long AS (SELECT place, name, cell, TRY_CAST(cell AS DOUBLE) AS x FROM (SELECT customer_id AS place, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in COLUMNS)} FROM t) UNPIVOT INCLUDE NULLS (cell FOR name IN ({', '.join(COLUMNS)})))"
_KINDS = f"""{_T}, p AS (SELECT name, count(*) AS n_rows, count(cell) AS n, count(DISTINCT cell) AS "unique", arg_min(cell, place) AS "first", arg_max(cell, place) AS latest, min(x) AS low, max(x) AS high, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS deviation,
CASE WHEN count(cell) = 0 THEN 'empty' WHEN bool_and(cell IN ('true', 'false')) THEN 'boolean' WHEN count(x) = count(cell) THEN 'numeric' ELSE 'categorical' END AS kind FROM long GROUP BY name)"""


def _profiled(s: SparkSession, d: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    return P.column_profile(_table(s, d), list(columns), "customer_id")


def _column_profile(s: SparkSession, d: str) -> DataFrame:
    text = F.col("kind") != "numeric"
    moments = [F.round(c, 4).alias(c) for c in ("low", "high", "mean", "median", "deviation")]
    return _profiled(s, d).select("name", "kind", *[F.col(c).cast("bigint").alias(c) for c in ("n", "missing", "unique")], "missing_percent", *[F.when(text, F.col(c)).alias(c) for c in ("first", "latest")], *moments)


QUERIES["column_profile"] = _column_profile
SQL["column_profile"] = f"""{_KINDS} SELECT name, kind, CAST(n AS BIGINT) AS n, CAST(n_rows - n AS BIGINT) AS missing, CAST("unique" AS BIGINT) AS "unique", round((n_rows - n) / n_rows * 100, 6) AS missing_percent, CASE WHEN kind <> 'numeric' THEN "first" END AS "first", CASE WHEN kind <> 'numeric' THEN latest END AS latest,
{', '.join(f"CASE WHEN kind = 'numeric' THEN round({c}, 4) END AS {c}" for c in ('low', 'high', 'mean', 'median', 'deviation'))} FROM p"""
_DATA = ("segment", "region", "n_orders", "priorities", "debt", "land")
QUERIES["dataset_profile"] = lambda s, d: P.dataset_profile(_table(s, d), list(_DATA), _profiled(s, d, _DATA)).select(*[F.col(c).cast("bigint").alias(c) for c in ("n_rows", "n_columns", "duplicates", "missing")], "numeric", "categorical", "datetime", "constant")
SQL["dataset_profile"] = f"""{_KINDS}, k AS (SELECT * FROM p WHERE name IN {_DATA}), g AS (SELECT count(*) AS k FROM t GROUP BY {', '.join(_DATA)})
SELECT (SELECT CAST(sum(k) AS BIGINT) FROM g) AS n_rows, CAST({len(_DATA)} AS BIGINT) AS n_columns, (SELECT CAST(sum(k - 1) AS BIGINT) FROM g) AS duplicates, CAST(sum(n_rows - n) AS BIGINT) AS missing,
coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = 'numeric'), '') AS "numeric", coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = 'categorical'), '') AS categorical, '' AS datetime, coalesce(string_agg(name, ',' ORDER BY name) FILTER ("unique" <= 1), '') AS constant FROM k"""
QUERIES["profile_tool"] = lambda s, d: P.dataset_profile(_table(s, d), list(COLUMNS), _profiled(s, d)).select(F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_columns").cast("bigint").alias("n_columns"), "numeric", F.col("missing").cast("bigint").alias("missing"))
SQL["profile_tool"] = f"""{_KINDS} SELECT (SELECT count(*) FROM t) AS n_rows, CAST(count(*) AS BIGINT) AS n_columns, string_agg(name, ',' ORDER BY name) FILTER (kind = 'numeric') AS "numeric", CAST(sum(n_rows - n) AS BIGINT) AS missing FROM p"""
QUERIES["limit_preview"] = lambda s, d: V.customers(s, d).orderBy("customer_id").limit(5).select("customer_id", "segment", "region", "balance")
SQL["limit_preview"] = f"WITH {V.CUSTOMERS_SQL} SELECT customer_id, segment, region, balance FROM customers ORDER BY customer_id LIMIT 5"
QUERIES["bounded_id_list"] = lambda s, d: bounded_ids(E.notable(V.event_log(s, d)), "event_id", ["source_row"]).select("ids")
SQL["bounded_id_list"] = f"{Q._LOG}, {Q._FLAGS}, f AS (SELECT event_id, row_number() OVER (ORDER BY CAST(event_id AS BIGINT)) AS k, count(*) OVER () AS n FROM notable) SELECT max(n) || ' ID · ' || string_agg(event_id, ', ' ORDER BY k) || CASE WHEN max(n) > 12 THEN ' … (ещё ' || (max(n) - 12) || ')' ELSE '' END AS ids FROM f WHERE k <= 12"

# -- shapes ------------------------------------------------------------------


def _shapes(s: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    people = V.customers(s, d).select("customer_id", "segment", "balance", "spent")
    weeks = V.weekly(s, d).select(F.date_format("week", "yyyy-MM-dd").alias("date"), F.date_diff("week", F.lit("1990-01-01").cast("date")).alias("at"), "revenue", "urgent")
    log = V.event_log(s, d).select("event_id", "entity_id", F.date_format(F.timestamp_micros("micros"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "event_type", "value", "source_row")
    mixed = V.customers(s, d).select(F.col("customer_id").alias("row"), "segment", "region")
    return [
        ("people", people, P.shape(people, ["customer_id", "segment", "balance", "spent"], "customer_id", {})),
        ("weeks", weeks, P.shape(weeks, ["date", "revenue", "urgent"], "at", {})),
        ("log", log, P.shape(log, ["event_id", "entity_id", "timestamp", "event_type", "value"], "source_row", {"event_id": "EVENT_ID", "entity_id": "ENTITY_ID", "timestamp": "EVENT_TIMESTAMP", "event_type": "EVENT_TYPE"})),
        ("mixed", mixed, P.shape(mixed, ["segment", "region"], "row", {})),
    ]


def _profile_shape(s: SparkSession, d: str) -> DataFrame:
    parts = [shape.withColumn("name", F.lit(name)) for name, _, shape in _shapes(s, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _admit(s: SparkSession, d: str) -> DataFrame:
    parts = [P.admission(shape, table).withColumn("name", F.lit(name)) for name, table, shape in _shapes(s, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_SHAPES = f"""WITH {V.CUSTOMERS_SQL}, {V.WEEKLY_SQL}, {V.EVENTS_SQL.format(entity='user_id')}, shapes AS (
SELECT 'people' AS name, CASE WHEN count(*) = count(DISTINCT customer_id) THEN 'CROSS_SECTIONAL' ELSE 'AMBIGUOUS_TABULAR' END AS tag, CAST(NULL AS VARCHAR) AS time_column, 'balance,spent' AS measures FROM customers
UNION ALL SELECT 'weeks', CASE WHEN bool_and(week > p) AND count(*) >= 3 THEN 'TIME_SERIES' ELSE 'AMBIGUOUS_TABULAR' END, 'date', 'revenue,urgent' FROM (SELECT week, lag(week) OVER (ORDER BY week) AS p FROM weekly)
UNION ALL SELECT 'log', CASE WHEN count(micros) = count(*) AND count(event_type) = count(*) AND (count(event_id) = count(*) OR count(entity_id) = count(*)) THEN 'EVENT_TRANSACTION' ELSE 'AMBIGUOUS_TABULAR' END, 'timestamp', 'value' FROM log
UNION ALL SELECT 'mixed', 'AMBIGUOUS_TABULAR', NULL, '')"""
QUERIES["profile_shape"] = _profile_shape
SQL["profile_shape"] = f"{_SHAPES} SELECT name, tag, time_column, measures FROM shapes"
QUERIES["admit"] = _admit
SQL["admit"] = f"{_SHAPES} SELECT name, tag, CASE WHEN tag = 'AMBIGUOUS_TABULAR' THEN 'NEEDS_INPUT' ELSE 'PROCEED' END AS status, CASE tag WHEN 'CROSS_SECTIONAL' THEN 'cross-sectional-investigation' WHEN 'EVENT_TRANSACTION' THEN 'event-transaction-investigation' WHEN 'TIME_SERIES' THEN 'generic-time-series-investigation' END AS workflow FROM shapes"

# -- schemas -----------------------------------------------------------------

#: A small vocabulary to try the rules with: domain, metric, alias, strong,
#: characteristic, outcome, excluded.
VOCABULARY = [
    ("SALES", "order_value", "totalprice", True, False, False, False),
    ("SALES", "order_value", "o totalprice", True, False, False, False),
    ("SALES", "order_date", "o-orderdate", False, True, False, False),
    ("SALES", "priority", "o_orderpriority", False, True, False, False),
    ("SALES", "status", "o_orderstatus", False, False, True, False),
    ("SUPPLY", "quantity", "l_quantity", True, False, False, False),
    ("SUPPLY", "ship_date", "L SHIPDATE", False, True, False, False),
    ("SUPPLY", "discount", "l_discount", False, True, True, False),
    ("SUPPLY", "order_date", "o_orderdate", False, False, False, False),
    ("PEOPLE", "balance", "c_acctbal", True, False, True, False),
    ("PEOPLE", "order_value", "o_totalprice", False, False, False, True),
]
HINTS = [("SALES", 2, 3), ("SUPPLY", 2, 3), ("PEOPLE", 1, 3)]
_FLAGS = ("strong", "characteristic", "outcome", "excluded")


def _vocabulary(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return s.createDataFrame(VOCABULARY, "domain string, metric string, alias string, strong boolean, characteristic boolean, outcome boolean, excluded boolean"), s.createDataFrame(HINTS, "domain string, minimum_match int, minimum_margin int")


def _headers(s: SparkSession, d: str, table: str) -> DataFrame:
    return s.createDataFrame([(c,) for c in V.table(s, d, table).columns], "name string")


_QUOTED = ", ".join(str(row).replace("True", "true").replace("False", "false") for row in VOCABULARY)
_VOCABULARY = f"""WITH words AS (SELECT *, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS key FROM (VALUES {_QUOTED}) t(domain, metric, alias, {', '.join(_FLAGS)})), hints AS (SELECT * FROM (VALUES {', '.join(map(str, HINTS))}) t(domain, minimum_match, minimum_margin)),
headers AS (SELECT column_name AS name, trim(regexp_replace(lower(column_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM (DESCRIBE orders))"""
QUERIES["resolve_dataset_schema"] = lambda s, d: P.resolve_schema(_headers(s, d, "orders"), *_vocabulary(s)).select("domain", *[F.col(c).cast("bigint").alias(c) for c in ("metrics", "score")], "eligible", "status")
SQL["resolve_dataset_schema"] = f"""{_VOCABULARY}, m AS (SELECT domain, metric, {', '.join(f'bool_or({c}) AS {c}' for c in _FLAGS)} FROM headers JOIN words USING (key) GROUP BY 1, 2),
s AS (SELECT domain, count(*) AS metrics, count(*) * 2 + 5 * count(*) FILTER (strong) + 3 * count(*) FILTER (characteristic) + count(*) FILTER (outcome) AS score, count(*) >= any_value(minimum_match) AND (count(*) FILTER (strong) >= 1 OR count(*) FILTER (characteristic) >= 2) AND NOT bool_or(excluded) AS eligible, any_value(minimum_margin) AS margin FROM m JOIN hints USING (domain) GROUP BY 1),
best AS (SELECT * FROM s WHERE eligible ORDER BY score DESC, domain LIMIT 1), rest AS (SELECT max(score) AS next FROM s WHERE domain NOT IN (SELECT domain FROM best))
SELECT domain, CAST(metrics AS BIGINT) AS metrics, CAST(score AS BIGINT) AS score, eligible, CASE WHEN domain IN (SELECT domain FROM best) THEN CASE WHEN (SELECT score - next < margin FROM best, rest) THEN 'AMBIGUOUS' ELSE 'RESOLVED' END END AS status FROM s"""
QUERIES["domain_alias_join"] = lambda s, d: _headers(s, d, "orders").withColumn("key", P.header_key(F.col("name"))).join(_vocabulary(s)[0].withColumn("key", P.header_key(F.col("alias"))), "key").select("name", "domain", "metric").distinct()
SQL["domain_alias_join"] = f"{_VOCABULARY} SELECT DISTINCT name, domain, metric FROM headers JOIN words USING (key)"
QUERIES["schema_rename"] = lambda s, d: P.schema_names(_headers(s, d, "orders"), _vocabulary(s)[0].filter("domain = 'SALES'")).select("name", "renamed", "status")
SQL["schema_rename"] = f"""{_VOCABULARY}, m AS (SELECT DISTINCT headers.name, metric FROM headers LEFT JOIN (SELECT key, metric FROM words WHERE domain = 'SALES') w USING (key)), k AS (SELECT metric, count(*) AS k FROM m WHERE metric IS NOT NULL GROUP BY 1)
SELECT name, CASE WHEN k = 1 THEN m.metric ELSE name END AS renamed, CASE WHEN k = 1 THEN 'MATCHED' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS status FROM m LEFT JOIN k USING (metric)"""
CONCEPTS = [("segment", "CATEGORICAL", ""), ("region", "IDENTIFIER", ""), ("balance", "NUMERIC", "MONEY"), ("n_orders", "NUMERIC", "COUNT"), ("spent", "NUMERIC", "PERCENTAGE"), ("priorities", "NUMERIC", "DURATION"), ("debt", "NUMERIC", "COUNT"), ("land", "CATEGORICAL", "")]
QUERIES["structural_validation"] = lambda s, d: P.structure(P.cells(_table(s, d), list(COLUMNS), "customer_id"), s.createDataFrame(CONCEPTS, "name string, kind string, unit string"))
SQL["structural_validation"] = f"""{_T}, c AS (SELECT * FROM (VALUES {', '.join(map(str, CONCEPTS))}) t(name, concept, unit)),
f AS (SELECT name, count(*) AS rows, count(cell) AS n, count(x) AS numbers, count(DISTINCT lower(cell)) AS uniq, coalesce(bool_and(x >= 0), true) AS positive, coalesce(bool_and(abs(x - round(x)) <= 1e-9), true) AS whole, count(*) FILTER (abs(x - round(x)) > 1e-9) AS fractions, max(x) AS high, coalesce(bool_or(x > 0 AND x < 1) AND bool_or(x > 1), false) AS mixed FROM long GROUP BY 1),
r AS (SELECT name, list_filter([
CASE WHEN NOT (n >= 3 AND (rows - n) / rows <= 0.05) THEN 'support' END, CASE WHEN concept = 'NUMERIC' AND numbers / n < 0.95 THEN 'numeric_compatibility' END, CASE WHEN concept = 'NUMERIC' AND numbers <> n THEN 'numeric_borderline' END,
CASE WHEN concept = 'NUMERIC' AND unit = 'COUNT' AND numbers > 0 AND NOT (positive AND whole) THEN 'count_unit' END, CASE WHEN concept = 'NUMERIC' AND unit = 'DURATION' AND numbers > 0 AND NOT positive THEN 'duration_unit' END,
CASE WHEN concept = 'NUMERIC' AND unit = 'PERCENTAGE' AND numbers > 0 AND NOT (positive AND high <= 100) THEN 'percentage_range' END, CASE WHEN concept = 'NUMERIC' AND unit = 'PERCENTAGE' AND mixed THEN 'percentage_scale' END,
CASE WHEN concept = 'IDENTIFIER' AND uniq / n < 0.95 THEN 'identifier_uniqueness' END, CASE WHEN concept = 'IDENTIFIER' AND numbers = n AND fractions / numbers >= 0.8 THEN 'identifier_measure_distribution' END,
CASE WHEN concept = 'CATEGORICAL' AND uniq <= 1 THEN 'categorical_variation' END, CASE WHEN concept = 'CATEGORICAL' AND NOT (n >= 5 AND uniq / n <= 0.8) THEN 'categorical_cardinality' END], lambda x: x IS NOT NULL) AS failed,
concept = 'NUMERIC' AND (numbers = 0 OR (unit = 'COUNT' AND NOT (positive AND whole)) OR (unit = 'DURATION' AND NOT positive) OR (unit = 'PERCENTAGE' AND NOT (positive AND high <= 100))) OR concept = 'IDENTIFIER' AND (n >= 3 AND uniq / n < 0.5 OR numbers = n AND fractions / numbers >= 0.8) AS rejected FROM f JOIN c USING (name))
SELECT name, CASE WHEN rejected THEN 'REJECTED' WHEN len(failed) > 0 THEN 'AMBIGUOUS' ELSE 'STRUCTURALLY_CONFIRMED' END AS verdict, array_to_string(failed, ',') AS failed FROM r"""

# -- associations of a class, findings, steps --------------------------------


def _class_associations(s: SparkSession, d: str) -> DataFrame:
    """Predictors of a class: spread of their means over its values, or cell counts."""
    rows = V.customers(s, d)
    parts = []
    for name in ("balance", "n_orders", "spent", "priorities"):
        means = rows.filter(F.col(name).isNotNull() & F.col("segment").isNotNull()).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg(name).alias("mean"))
        spread = means.agg(F.sum("n").cast("bigint").alias("n"), (F.max("mean") - F.min("mean")).alias("reach"), F.count(F.lit(1)).alias("groups"))
        parts.append(spread.join(F.broadcast(rows.agg(F.stddev_pop(name).alias("sd")))).filter("groups > 1").select(F.lit("NUMERIC_BY_TARGET_GROUP").alias("method"), F.lit(name).alias("name"), "n", F.round(F.coalesce(F.try_divide("reach", "sd"), F.lit(0.0)), 6).alias("strength")))
    cells = rows.filter("region is not null and segment is not null").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    parts.append(cells.select(F.lit("CONTINGENCY").alias("method"), F.lit("region").alias("name"), "n", F.lit(None).cast("double").alias("strength")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


QUERIES["associations_of_class"] = _class_associations
SQL["associations_of_class"] = f"WITH {V.CUSTOMERS_SQL} " + " UNION ALL ".join([f"SELECT 'NUMERIC_BY_TARGET_GROUP' AS method, '{c}' AS name, CAST(sum(n) AS BIGINT) AS n, round(coalesce((max(m) - min(m)) / nullif((SELECT stddev_pop({c}) FROM customers), 0), 0), 6) AS strength FROM (SELECT count(*) AS n, avg({c}) AS m FROM customers WHERE {c} IS NOT NULL GROUP BY segment)" for c in ("balance", "n_orders", "spent", "priorities")] + ["SELECT 'CONTINGENCY', 'region', count(*), CAST(NULL AS DOUBLE) FROM customers"])


def _analysis(s: SparkSession, d: str) -> DataFrame:
    stats = Q._series(s, d).groupBy("signal").agg(F.count(F.lit(1)).alias("rows"), F.count("x").cast("bigint").alias("n"), F.max_by("x", "idx").alias("latest"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    z = F.coalesce(F.try_divide(F.col("latest") - F.col("mean"), "sd"), F.lit(0.0))
    return stats.select("signal", "n", F.round("latest", 2).alias("latest"), F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), F.round(z, 6).alias("z"), F.when(z > 0, "rising").when(z < 0, "falling").otherwise("stable").alias("direction"), F.round((F.col("rows") - F.col("n")) / F.col("rows") * 100, 6).alias("missing_percent"), (F.abs(z) >= 1).alias("finding"), (F.col("n") < 30).alias("small_sample"))


QUERIES["generic_analyze"] = _analysis
SQL["generic_analyze"] = f"""{Q._TS}, a AS (SELECT signal, count(*) AS rows, count(x) AS n, arg_max(x, idx) AS latest, avg(x) AS mean, stddev_pop(x) AS sd FROM long GROUP BY 1), z AS (SELECT *, coalesce((latest - mean) / nullif(sd, 0), 0) AS z FROM a)
SELECT signal, CAST(n AS BIGINT) AS n, round(latest, 2) AS latest, round(mean, 2) AS mean, round(sd, 2) AS sd, round(z, 6) AS z, CASE WHEN z > 0 THEN 'rising' WHEN z < 0 THEN 'falling' ELSE 'stable' END AS direction, round(CAST(rows - n AS DOUBLE) / rows * 100, 6) AS missing_percent, abs(z) >= 1 AS finding, n < 30 AS small_sample FROM z"""


#: Lags at which a signal may lead; fixed for the example.
EXPECTED = (1, 2)


def _edges(s: SparkSession, d: str) -> DataFrame:
    r, lag = F.abs("r"), F.col("lag")
    strength = F.when(r < 0.2, "very_weak").when(r < 0.4, "weak").when(r < 0.6, "moderate").when(r < 0.8, "strong").otherwise("very_strong")
    timing = F.when(lag <= 0, "not_temporally_leading").when(lag.between(*EXPECTED), "consistent_with_domain_prior").otherwise("outside_expected_range")
    sign = F.when(F.col("r") < 0, "negative").when(F.col("r") > 0, "positive").otherwise("none")
    return Q._strongest(s, d).select("signal", "lag", strength.alias("strength"), timing.alias("timing"), sign.alias("sign"))


QUERIES["interpret_edge"] = _edges
SQL["interpret_edge"] = f"""{Q._LAGS}, {Q._BEST} SELECT signal, CAST(lag AS BIGINT) AS lag, CASE WHEN abs(r) < 0.2 THEN 'very_weak' WHEN abs(r) < 0.4 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' WHEN abs(r) < 0.8 THEN 'strong' ELSE 'very_strong' END AS strength,
CASE WHEN lag <= 0 THEN 'not_temporally_leading' WHEN lag BETWEEN {EXPECTED[0]} AND {EXPECTED[1]} THEN 'consistent_with_domain_prior' ELSE 'outside_expected_range' END AS timing, CASE WHEN r < 0 THEN 'negative' WHEN r > 0 THEN 'positive' ELSE 'none' END AS sign FROM best WHERE k = 1"""


def _next_steps(s: SparkSession, d: str) -> DataFrame:
    """Codes of what to check next, in their order, from counts and the risk label."""
    risk = QUERIES_RISK(s, d)
    facts = Q._series(s, d).agg(F.max("n_rows").alias("rows"), F.count_if(F.col("x").isNull()).alias("gaps"))
    steps = F.array_compact(F.array(F.when(F.col("rows") < 30, "more_observations"), F.when(F.col("gaps") > F.col("rows") * 0.1, "data_quality"), F.when(F.col("label").isNull(), "choose_other_columns").when(F.col("label") == "HIGH", "review_leading_signals").when(F.col("label") == "LOW", "repeat_later"), F.lit("human_decides")))
    return facts.join(F.broadcast(risk), how="left").select(F.array_join(steps, ",").alias("steps"))


QUERIES_RISK = Q.QUERIES["risk_indicator"]
QUERIES["next_steps"] = _next_steps
SQL["next_steps"] = f"""WITH risk AS ({Q.SQL['risk_indicator']}), {V.WEEKLY_SQL} SELECT array_to_string(list_filter([CASE WHEN max(n_rows) < 30 THEN 'more_observations' END, CASE WHEN count(*) FILTER (x IS NULL) > max(n_rows) * 0.1 THEN 'data_quality' END,
CASE (SELECT label FROM risk) WHEN 'HIGH' THEN 'review_leading_signals' WHEN 'LOW' THEN 'repeat_later' END, 'human_decides'], lambda x: x IS NOT NULL), ',') AS steps FROM long"""
QUERIES["fixture_provenance"] = lambda s, d: V.weekly(s, d).agg(F.bool_and(F.abs(F.col("mean_price") * F.col("n_orders") - F.col("revenue")) <= 1).alias("mean_from_revenue"), F.bool_and(F.col("urgent") == F.col("finished")).alias("urgent_is_finished"))
SQL["fixture_provenance"] = f"WITH {V.WEEKLY_SQL} SELECT bool_and(abs(mean_price * n_orders - revenue) <= 1) AS mean_from_revenue, bool_and(urgent = finished) AS urgent_is_finished FROM weekly"
QUERIES["event_evidence"] = lambda s, d: _evidence(s, d)


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """One row for each canonical piece of evidence on a log, with its count."""
    log = V.event_log(s, d)
    counted = [("E-001", "profile", log), ("E-002", "types", E.type_counts(log)), ("E-003", "activity", E.entity_activity(log)), ("E-004", "timing", E.groups(log, ["entity_id"], 3)), ("E-005", "repeats", E.groups(log, E.REPEAT, 2)), ("E-006", "notable", E.notable(log)), ("E-007", "related", E.groups(log, ["entity_id"], 2))]
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(k).alias("id"), F.lit(tool).alias("tool"), "n") for k, tool, df in counted]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _runs_of(keys: str, least: int, mark: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT {keys}, run FROM (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY ms, source_row) AS run FROM (SELECT *, CASE WHEN ms - lag(ms) OVER {mark} > 300000 OR lag(ms) OVER {mark} IS NULL THEN 1 ELSE 0 END AS opens FROM ms WINDOW {mark} AS (PARTITION BY {keys} ORDER BY ms, source_row))) GROUP BY {keys}, run HAVING count(*) >= {least}))"""


SQL["event_evidence"] = f"""{Q._LOG}, {Q._FLAGS} SELECT 'E-001' AS id, 'profile' AS tool, count(*) AS n FROM log UNION ALL SELECT 'E-002', 'types', count(DISTINCT event_type) FROM log UNION ALL SELECT 'E-003', 'activity', count(DISTINCT entity_id) FROM log
UNION ALL SELECT 'E-004', 'timing', {_runs_of('entity_id', 3, 'w1')} UNION ALL SELECT 'E-005', 'repeats', {_runs_of('entity_id, event_type, value', 2, 'w2')} UNION ALL SELECT 'E-006', 'notable', count(*) FROM notable UNION ALL SELECT 'E-007', 'related', {_runs_of('entity_id', 2, 'w3')}"""
QUERIES["asof_month"] = lambda s, d: V.opening(V.monthly(s, d)).agg(F.max("month").alias("as_of"))
SQL["asof_month"] = f"WITH {V.facts_sql()} SELECT max(month) AS as_of FROM opening"
QUERIES["numeric_cell"] = lambda s, d: V.table(s, d, "orders").select("o_orderkey", P.numeric_cell(F.concat(F.when(F.col("o_orderkey") % 5 == 0, "~").otherwise(""), F.lit(" "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(" "), F.lit("250.5"))).alias("x"))
SQL["numeric_cell"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_orderkey % 1000) || '250.5' AS DOUBLE) END AS x FROM orders"
QUERIES["period_time"] = lambda s, d: V.table(s, d, "orders").select("o_orderkey", F.unix_micros(P.period_time(F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("32.01.2000"), F.lit("20000101")), (F.col("o_orderkey") % 5 + 1).cast("int")))).alias("micros"))
SQL["period_time"] = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) WHEN 1 THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) WHEN 2 THEN epoch_us(date_trunc('month', CAST(o_orderdate AS TIMESTAMP))) END AS micros FROM orders"
