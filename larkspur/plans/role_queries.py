"""Queries on roles found in the data: keys, targets, what goes with them, events, and
whether results can be trusted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.canonical import row_json
from larkspur.functions.checkpoints import kept
from larkspur.operators import events as E
from larkspur.operators import roles as R
from larkspur.operators import slices as S
from larkspur.operators.cross_section import Section
from larkspur.plans import views as V
from larkspur.plans.investigation_queries import _FLAGS, _LOG, _runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- keys and targets ---------------------------------------------------------

_TABLES = ("region", "customer", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _entities(s: SparkSession, d: str) -> DataFrame:
    rows = [(name, R.entity_column(V.table(s, d, name)), V.table(s, d, name).count()) for name in _TABLES]
    return s.createDataFrame(rows, "table string, entity_column string, n_rows bigint")


QUERIES["entity_column"] = _entities
_HINTED = {"events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}
SQL["entity_column"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", coalesce((SELECT name FROM (SELECT name, count(*) AS n, count(DISTINCT cell) AS k FROM (UNPIVOT (SELECT CAST(COLUMNS('(?i)(^id$|_id$|^id_|client|customer|account|entity)') AS VARCHAR) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE cell) GROUP BY name)
  WHERE k = (SELECT count(*) FROM {t}) ORDER BY (SELECT column_index FROM duckdb_columns() c WHERE c.table_name = '{t}' AND c.column_name = name LIMIT 1) LIMIT 1), '__source_row__') AS entity_column, (SELECT count(*) FROM {t}) AS n_rows"""
    if t in _HINTED
    else f"""SELECT '{t}' AS "table", '__source_row__' AS entity_column, (SELECT count(*) FROM {t}) AS n_rows"""
    for t in _TABLES
)


def applicants(s: SparkSession, d: str) -> DataFrame:
    """Customers under the names of an upload, with a score and what belongs to it."""
    rows = V.customers(s, d)
    return rows.select(
        F.col("customer_id").alias("ID клиента"),
        "segment",
        "region",
        "balance",
        "n_orders",
        "priorities",
        F.col("spent").alias("Риск-балл"),
        F.round(F.abs("balance") / 10000, 4).alias("DTI %"),
        F.when(F.col("balance") < 0, 1).otherwise(0).alias("Просрочка текущая"),
        (500 + F.col("customer_id") % 300).alias("credit_rating"),
    )


_APPLICANTS = f"""WITH {V.CUSTOMERS_SQL}, app AS (SELECT customer_id, segment, region, balance, n_orders, priorities, spent AS score, round(abs(balance) / 10000, 4) AS dti, CASE WHEN balance < 0 THEN 1 ELSE 0 END AS late, 500 + customer_id % 300 AS rating FROM customers),
nums AS (SELECT customer_id, segment, score, name, x FROM app CROSS JOIN LATERAL (VALUES ('balance', CAST(balance AS DOUBLE)), ('n_orders', n_orders), ('priorities', priorities), ('Риск-балл', score), ('DTI %', dti), ('Просрочка текущая', CAST(late AS DOUBLE)), ('credit_rating', CAST(rating AS DOUBLE))) t(name, x))"""


def _targets(s: SparkSession, d: str) -> DataFrame:
    tables = {"applicants": applicants(s, d), "customers": V.customers(s, d), "flagged": V.customers(s, d).withColumn("Risk Category", F.when(F.col("balance") < 0, "HIGH").otherwise("low"))}
    asked = [("applicants", None), ("applicants", "segment"), ("applicants", "ID клиента"), ("applicants", "nowhere"), ("customers", None), ("customers", "spent"), ("flagged", None)]
    known = {name: R.kinds(df) for name, df in tables.items()}
    rows = []
    for name, explicit in asked:
        t = R.resolve_target(tables[name], explicit, known[name])
        rows.append((name, explicit or "", t.column, t.source, t.kind, t.authoritative))
    return s.createDataFrame(rows, "table string, asked string, column string, source string, kind string, authoritative boolean")


QUERIES["resolve_target"] = _targets
_KIND = "CASE WHEN count(x) > 0 AND count(x) = count(TRY_CAST(x AS DOUBLE)) THEN 'NUMERIC' WHEN count(x) > 0 AND NOT bool_and(x IN ('true', 'false')) THEN 'CATEGORICAL' END"
SQL["resolve_target"] = f"""WITH {V.CUSTOMERS_SQL}, cell AS (SELECT * FROM customers CROSS JOIN LATERAL (VALUES ('spent', CAST(spent AS VARCHAR)), ('segment', segment), ('key', CAST(customer_id AS VARCHAR)), ('category', CASE WHEN balance < 0 THEN 'HIGH' ELSE 'low' END)) t(name, x)),
k AS (SELECT name, {_KIND} AS kind FROM cell GROUP BY name),
asked AS (SELECT * FROM (VALUES ('applicants', '', 'Риск-балл', 'spent'), ('applicants', 'segment', 'segment', 'segment'), ('applicants', 'ID клиента', 'ID клиента', 'key'), ('applicants', 'nowhere', NULL, NULL), ('customers', '', NULL, NULL), ('customers', 'spent', 'spent', 'spent'), ('flagged', '', 'Risk Category', 'category')) t("table", asked, "column", name))
SELECT "table", asked, CASE WHEN kind IS NOT NULL THEN "column" END AS "column", CASE WHEN kind IS NULL THEN 'NONE' WHEN asked <> '' THEN 'EXPLICIT' ELSE 'KNOWN_ALIAS' END AS source, kind, kind IS NOT NULL AS authoritative FROM asked LEFT JOIN k USING (name)"""

# -- relations to the target --------------------------------------------------


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


QUERIES["target_associations"] = lambda s, d: _rounded(Section(applicants(s, d)).associations(), "value", "strength")
QUERIES["target_groups"] = lambda s, d: _rounded(Section(applicants(s, d)).groups(), "mean").drop("target_value")
QUERIES["class_associations"] = lambda s, d: _rounded(Section(applicants(s, d), "segment").associations(), "value", "strength")
QUERIES["class_groups"] = lambda s, d: _rounded(Section(applicants(s, d), "segment").groups(), "mean")
QUERIES["target_drivers"] = lambda s, d: _rounded(Section(applicants(s, d)).drivers(), "strength")
_GROUPS = "g AS (SELECT 'segment' AS predictor, segment AS value, count(score) AS n, avg(score) AS mean FROM app WHERE segment IS NOT NULL AND score IS NOT NULL GROUP BY segment UNION ALL SELECT 'region', region, count(score), avg(score) FROM app WHERE region IS NOT NULL AND score IS NOT NULL GROUP BY region)"
_RELATED = f"""{_APPLICANTS}, {_GROUPS}, p AS (SELECT name, count(*) AS n, coalesce(covar_pop(x, score) / nullif(stddev_pop(x) * stddev_pop(score), 0), 0) AS r FROM nums WHERE name <> 'Риск-балл' AND x IS NOT NULL AND score IS NOT NULL GROUP BY name),
rel AS (SELECT 'PEARSON' AS method, name AS predictor, n, r AS value, abs(r) AS strength FROM p WHERE n >= 3 UNION ALL
SELECT 'GROUP_MEAN_RANGE', predictor, sum(n), NULL, (max(mean) - min(mean)) / (SELECT stddev_pop(score) FROM app) FROM g GROUP BY predictor HAVING count(*) > 1)"""
SQL["target_associations"] = f"{_RELATED} SELECT method, predictor, CAST(n AS BIGINT) AS n, round(value, 6) AS value, round(strength, 6) AS strength FROM rel"
SQL["target_groups"] = f"{_APPLICANTS}, {_GROUPS} SELECT 'GROUP_MEAN_RANGE' AS method, predictor, value, n, round(mean, 6) AS mean FROM g"
SQL["target_drivers"] = f"{_RELATED} SELECT row_number() OVER (ORDER BY method = 'GROUP_MEAN_RANGE', strength DESC, predictor) AS rank, method, predictor, round(strength, 6) AS strength FROM rel ORDER BY 1 LIMIT 5"
_CLASS = f"""{_APPLICANTS}, m AS (SELECT 'NUMERIC_BY_TARGET_GROUP' AS method, name AS predictor, segment AS value, count(x) AS n, avg(x) AS mean FROM nums WHERE segment IS NOT NULL AND x IS NOT NULL GROUP BY name, segment),
c AS (SELECT region AS value, segment AS target_value, count(*) AS n FROM app WHERE region IS NOT NULL AND segment IS NOT NULL GROUP BY ALL)"""
SQL["class_groups"] = f"{_CLASS} SELECT method, predictor, value, NULL AS target_value, n, round(mean, 6) AS mean FROM m UNION ALL SELECT 'CONTINGENCY', 'region', value, target_value, n, NULL FROM c"
SQL["class_associations"] = f"""{_CLASS} SELECT method, predictor, CAST(sum(n) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value, round((max(mean) - min(mean)) / (SELECT stddev_pop(x) FROM nums WHERE nums.name = m.predictor), 6) AS strength FROM m GROUP BY method, predictor HAVING count(*) > 1
UNION ALL SELECT 'CONTINGENCY', 'region', CAST(sum(n) AS BIGINT), NULL, NULL FROM c"""
QUERIES["high_risk_entities"] = lambda s, d: Section(applicants(s, d)).high_risk("ID клиента").select("entity_id", "source_row", F.col("target_value").cast("double").alias("target_value"), "bound", "flags")
SQL["high_risk_entities"] = f"""{_APPLICANTS}, b AS (SELECT list_sort(list(score)) AS v, count(score) AS n FROM app WHERE score IS NOT NULL), lim AS (SELECT v[CAST(ceil(n * 0.75) AS INTEGER)] AS bound, (SELECT CASE WHEN max(dti) > 1 THEN 40 ELSE 0.4 END FROM app) AS most FROM b)
SELECT CAST(customer_id AS VARCHAR) AS entity_id, customer_id AS source_row, score AS target_value, bound, array_to_string(list_filter([CASE WHEN dti >= most THEN 'DTI' END, CASE WHEN late > 0 THEN 'CURRENT_DELINQUENCY' END, CASE WHEN rating < 600 THEN 'CREDIT_RATING' END], lambda x: x IS NOT NULL), ',') AS flags FROM app, lim WHERE score >= bound"""

# -- events under other names -------------------------------------------------


def raw_events(s: SparkSession, d: str) -> DataFrame:
    """The events as an upload: text cells under other names, with gaps and broken numbers."""
    rows = R.source_rows(V.table(s, d, "events"), "row")
    k = F.col("event_id")
    return rows.select(
        "row",
        F.when(k % 13 != 0, k.cast("string")).alias("Event ID"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Event Time"),
        F.when(k % 17 == 3, " ").otherwise(F.col("user_id").cast("string")).alias("User ID"),
        F.col("event_type").alias("Event Type"),
        F.when(k % 19 == 4, "NaN").when(k % 23 == 5, "1e999").when(k % 29 == 6, "Infinity").when(k % 31 == 7, "").when(k % 37 == 8, " 12.5 ").otherwise(F.col("value").cast("string")).alias("Amount"),
    )


QUERIES["normalized_events"] = lambda s, d: R.normalized_events(raw_events(s, d), R.event_semantics(raw_events(s, d).columns), "row").drop("timestamp")
SQL["normalized_events"] = """WITH e AS (SELECT *, row_number() OVER () AS source_row FROM events)
SELECT source_row, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id AS VARCHAR) ELSE 'ROW-' || source_row END AS event_id, CASE WHEN event_id % 17 = 3 THEN 'ALL_EVENTS' ELSE CAST(user_id AS VARCHAR) END AS entity_id, epoch_us(ts) AS micros, event_type,
  CASE WHEN event_id % 19 = 4 OR event_id % 23 = 5 OR event_id % 29 = 6 OR event_id % 31 = 7 THEN NULL WHEN event_id % 37 = 8 THEN 12.5 ELSE value END AS value FROM e"""

# -- validation ---------------------------------------------------------------


def _claimed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A log, and the log with one event changed: its type, and with it what depends on that."""
    log = V.event_log(s, d)
    return log, log.withColumn("event_type", F.when(F.col("event_id") == "17", "altered").otherwise(F.col("event_type")))


def _artifacts(s: SparkSession, d: str, *names: str) -> tuple[DataFrame, DataFrame]:
    log, other = _claimed(s, d)
    made = [S.event_artifact(x) for x in (other, log)]
    return tuple(kept(S.artifact({name: parts[name] for name in names or parts})) for parts in made)


_LISTED_SLICES = ("EVENT_COUNT", "EVENT_TYPE_COUNTS", "ENTITY_ACTIVITY", "NOTABLE_EVENT_SELECTION", "CLUSTER_MEMBERSHIP")
QUERIES["validate_event_slices"] = lambda s, d: S.validate(*_artifacts(s, d))
QUERIES["event_slice_differences"] = lambda s, d: S.differences(*_artifacts(s, d, *_LISTED_SLICES))
QUERIES["validate_section"] = lambda s, d: _section_checks(s, d)


def _section_checks(s: SparkSession, d: str) -> DataFrame:
    """A cross-section in which one customer's segment is changed, against the true one."""
    rows = applicants(s, d)
    other = rows.withColumn("segment", F.when(F.col("ID клиента") == 7, "ALTERED").otherwise(F.col("segment")))
    made = [kept(S.artifact(S.section_artifact(Section(x), "ID клиента"))) for x in (other, rows)]
    return S.validate(*made)


def _altered(log: str) -> str:
    return log.replace("CASE WHEN event_id % 50 = 7 THEN", "CASE WHEN event_id = 17 THEN 'altered' WHEN event_id % 50 = 7 THEN")


_TYPES = "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1"
_ENTITIES = "SELECT entity_id, min(ms) AS first_ms, max(ms) AS last_ms, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM ms GROUP BY 1"
_NEAR = _runs("entity_id", 2).replace("o AS", "o2 AS", 1).replace("FROM o)", "FROM o2)").replace("r AS (SELECT", "r2 AS (SELECT", 1).replace("FROM r)", "FROM r2)").replace("z AS", "z2 AS", 1).replace("FROM z ", "FROM z2 ").replace("runs AS", "near AS", 1)
_LISTED = f"""{_FLAGS}, {_NEAR}, x AS (SELECT 'EVENT_COUNT' AS slice, '{{"events":' || count(*) || '}}' AS "row" FROM log
UNION ALL SELECT 'EVENT_TYPE_COUNTS', '{{"event_type":' || to_json(event_type) || ',"n":' || n || ',"total":' || (SELECT count(*) FROM log) || '}}' FROM ({_TYPES})
UNION ALL SELECT 'ENTITY_ACTIVITY', '{{"entity_id":' || to_json(entity_id) || ',"first_ms":' || first_ms || ',"last_ms":' || last_ms || ',"n":' || n || ',"types":' || to_json(types) || '}}' FROM ({_ENTITIES})
UNION ALL SELECT 'NOTABLE_EVENT_SELECTION', '{{"entity_id":' || to_json(entity_id) || ',"event_id":' || to_json(event_id) || ',"event_type":' || to_json(event_type) || ',"reasons":' || CAST(to_json(string_split(reasons, ',')) AS VARCHAR) || ',"source_row":' || source_row || ',"value":' || CAST(value AS BIGINT) || '}}' FROM notable
UNION ALL SELECT 'CLUSTER_MEMBERSHIP', '{{"entity_id":' || to_json(entity_id) || ',"event_id":' || to_json(event_id) || ',"run":' || run || ',"source_row":' || source_row || '}}' FROM near)"""
SQL["event_slice_differences"] = f"""SELECT coalesce(a.slice, b.slice) AS slice, coalesce(a."row", b."row") AS "row", CAST(coalesce(a.n, 0) AS BIGINT) AS claimed, CAST(coalesce(b.n, 0) AS BIGINT) AS recomputed
FROM ({_altered(_LOG)}, {_LISTED} SELECT slice, "row", count(*) AS n FROM x GROUP BY ALL) a FULL JOIN ({_LOG}, {_LISTED} SELECT slice, "row", count(*) AS n FROM x GROUP BY ALL) b ON a.slice = b.slice AND a."row" = b."row" WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
_SLICED = f"""{_FLAGS}, {_NEAR}, s AS (SELECT 'EVENT_COUNT' AS "check", CAST(count(*) AS VARCHAR) AS t FROM log
UNION ALL SELECT 'EVENT_IDENTITY', concat_ws('|', count(DISTINCT event_id), count(DISTINCT entity_id), min(micros), max(micros)) FROM log
UNION ALL SELECT 'EVENT_TYPE_COUNTS', concat_ws('|', event_type, n) FROM ({_TYPES}) UNION ALL SELECT 'ENTITY_ACTIVITY', concat_ws('|', entity_id, n, types) FROM ({_ENTITIES})
UNION ALL SELECT 'TIMING_AND_BURSTS', concat_ws('|', entity_id, run, count(*), string_agg(DISTINCT event_type, ',' ORDER BY event_type)) FROM runs GROUP BY entity_id, run
UNION ALL SELECT 'NOTABLE_EVENT_SELECTION', concat_ws('|', event_id, event_type, reasons) FROM notable UNION ALL SELECT 'CLUSTER_MEMBERSHIP', concat_ws('|', entity_id, run, event_id) FROM near)"""
SQL["validate_event_slices"] = f"""SELECT "check", a.h = b.h AS passed, a.n AS claimed, b.n AS recomputed FROM ({_altered(_LOG)}, {_SLICED} SELECT "check", count(*) AS n, sum(hash(t)::HUGEINT) AS h FROM s GROUP BY 1) a JOIN ({_LOG}, {_SLICED} SELECT "check", count(*) AS n, sum(hash(t)::HUGEINT) AS h FROM s GROUP BY 1) b USING ("check")"""


def _records(s: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Evidence records: one an event and one an entity, some of them forged."""
    log = V.event_log(s, d)
    tools = S.event_tools(log)
    k = F.col("source_row")
    payload = row_json(log, "event_id", "entity_id", "event_type", "value", "source_row")
    of_events = log.select(
        F.concat(F.lit("E-"), "event_id").alias("evidence_id"),
        F.when(k % 41 == 3, "unknown_tool").when(k % 43 == 4, "summarize_event_types").otherwise("inspect_event_record").alias("tool"),
        F.when(k % 47 == 5, F.lit(None)).when(k % 53 == 6, F.concat("event_id", F.lit("-none"))).otherwise(F.col("event_id")).alias("requested_id"),
        F.when(k % 59 == 7, F.replace(payload, F.lit('"value":'), F.lit('"value":1'))).otherwise(payload).alias("payload"),
    )
    whole = [tools[t][1].select(F.lit(f"E-{t}").alias("evidence_id"), F.lit(t).alias("tool"), "requested_id", "payload") for t in ("summarize_event_types", "profile_event_transaction_dataset")]
    return of_events.unionByName(whole[0]).unionByName(whole[1]), tools


QUERIES["reproducible_evidence"] = lambda s, d: S.reproducible(*_records(s, d)).select("evidence_id", "reproducible")
SQL["reproducible_evidence"] = f"""{_LOG} SELECT 'E-' || event_id AS evidence_id, NOT (source_row % 41 = 3 OR source_row % 43 = 4 OR source_row % 47 = 5 OR source_row % 53 = 6 OR source_row % 59 = 7) AS reproducible FROM log
UNION ALL SELECT 'E-summarize_event_types', true UNION ALL SELECT 'E-profile_event_transaction_dataset', true"""


def _section_sql() -> str:
    parts = f"""{_RELATED}, t AS (SELECT 'ENTITY_COUNT' AS "check", CAST(count(*) AS VARCHAR) AS t FROM app UNION ALL SELECT 'TARGET_RESOLUTION', 'score'
    UNION ALL SELECT 'NUMERIC_SUMMARIES', concat_ws('|', name, count(x), min(x), max(x), round(avg(x), 6)) FROM nums GROUP BY name
    UNION ALL SELECT 'CATEGORY_COUNTS', concat_ws('|', 'segment', segment, count(*)) FROM app GROUP BY segment UNION ALL SELECT 'CATEGORY_COUNTS', concat_ws('|', 'region', region, count(*)) FROM app GROUP BY region
    UNION ALL SELECT 'ASSOCIATIONS', concat_ws('|', method, predictor, n, round(strength, 6)) FROM rel UNION ALL SELECT 'ASSOCIATION_GROUPS', concat_ws('|', predictor, value, n, round(mean, 6)) FROM g
    UNION ALL SELECT 'DRIVERS', concat_ws('|', method, predictor, round(strength, 6)) FROM (SELECT * FROM rel ORDER BY method = 'GROUP_MEAN_RANGE', strength DESC, predictor LIMIT 5)
    UNION ALL SELECT 'HIGH_RISK_SELECTION', CAST(customer_id AS VARCHAR) FROM app WHERE score >= (SELECT v[CAST(ceil(n * 0.75) AS INTEGER)] FROM (SELECT list_sort(list(score)) AS v, count(score) AS n FROM app WHERE score IS NOT NULL))
    UNION ALL SELECT 'DERIVED_PREVALENCE', concat_ws('|', count(*) FILTER (late > 0), count(*)) FROM app)"""
    changed = parts.replace("app AS (SELECT customer_id, segment,", "app AS (SELECT customer_id, CASE WHEN customer_id = 7 THEN 'ALTERED' ELSE segment END AS segment,")
    of = lambda text: f'({text} SELECT "check", count(*) AS n, sum(hash(t)::HUGEINT) AS h FROM t GROUP BY 1)'
    return f'SELECT "check", a.h = b.h AS passed, a.n AS claimed, b.n AS recomputed FROM {of(changed)} a JOIN {of(parts)} b USING ("check")'


SQL["validate_section"] = _section_sql()
