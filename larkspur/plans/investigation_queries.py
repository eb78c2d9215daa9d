"""Queries over event logs, cross-sections and series, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import clamp, pearson, percentage_change
from larkspur.functions.quantiles import medians, values_at
from larkspur.operators import events as E
from larkspur.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOG = f"WITH {V.EVENTS_SQL.format(entity='user_id')}, ms AS (SELECT *, micros // 1000 AS ms FROM log)"


def _runs(keys: str, least: int) -> str:
    return f"""o AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 300000 OR lag(ms) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM ms WINDOW w AS (PARTITION BY {keys} ORDER BY ms, source_row)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY ms, source_row) AS run FROM o), z AS (SELECT *, count(*) OVER (PARTITION BY {keys}, run) AS size FROM r), runs AS (SELECT * FROM z WHERE size >= {least})"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.event_log(spark, sf_dir)


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


QUERIES["event_type_counts"] = lambda s, d: _longs(E.type_counts(_log(s, d)), "n").select("event_type", "n", F.round("share", 9).alias("share"))
SQL["event_type_counts"] = f"{_LOG} SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM log), 9) AS share FROM log GROUP BY 1"
QUERIES["entity_activity"] = lambda s, d: _longs(E.entity_activity(_log(s, d)), "n")
SQL["entity_activity"] = f"{_LOG} SELECT entity_id, CAST(count(*) AS BIGINT) AS n, min(ms) AS first_ms, max(ms) AS last_ms, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM ms GROUP BY 1"
QUERIES["event_profile"] = lambda s, d: _longs(E.profile(_log(s, d)), "ids", "duplicates", "entities", "invalid")
SQL["event_profile"] = f'{_LOG} SELECT CAST(count(DISTINCT event_id) AS BIGINT) AS ids, CAST(count(event_id) - count(DISTINCT event_id) AS BIGINT) AS duplicates, CAST(count(DISTINCT entity_id) AS BIGINT) AS entities, CAST(count(*) FILTER (micros IS NULL) AS BIGINT) AS invalid, min(micros) AS "first", max(micros) AS "last" FROM log'
for _name, _keys, _least in (("bursts", ["entity_id"], 3), ("clusters", ["entity_id"], 2), ("type_bursts", ["event_type"], 3), ("repeated_patterns", E.REPEAT, 2), ("gap_sessions", ["entity_id"], 1)):

    def _grouped(s: SparkSession, d: str, keys=tuple(_keys), least=_least) -> DataFrame:
        return _longs(E.groups(_log(s, d), list(keys), least), "n").select(*keys, "n", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "types")

    QUERIES[_name] = _grouped
    _k = ", ".join(_keys)
    SQL[_name] = f"{_LOG}, {_runs(_k, _least)} SELECT {_k}, CAST(count(*) AS BIGINT) AS n, min(ms) AS start_ms, max(ms) - min(ms) AS duration_ms, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM runs GROUP BY {_k}, run"
QUERIES["rare_types"] = lambda s, d: _longs(E.rare_types(_log(s, d)), "n").select("event_type", "n")
SQL["rare_types"] = f"{_LOG} SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1 HAVING count(*) <= greatest(1, floor((SELECT count(*) FROM log) * 0.05))"
_BOUNDS = "v AS (SELECT list_sort(list(value)) AS v, count(value) AS n FROM log WHERE value IS NOT NULL), q AS (SELECT v[1 + CAST(floor((n - 1) * 0.25) AS INTEGER)] AS q1, v[1 + CAST(floor((n - 1) * 0.75) AS INTEGER)] AS q3 FROM v), bounds AS (SELECT q1, q3, q1 - (q3 - q1) * CAST(1.5 AS DOUBLE) AS low, q3 + (q3 - q1) * CAST(1.5 AS DOUBLE) AS high FROM q)"
QUERIES["value_bounds"] = lambda s, d: E.value_bounds(_log(s, d)).select(*[F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")])
SQL["value_bounds"] = f"{_LOG}, {_BOUNDS} SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high FROM bounds"
QUERIES["iqr_outliers"] = lambda s, d: E.outliers(_log(s, d)).select("event_id", "value")
SQL["iqr_outliers"] = f"{_LOG}, {_BOUNDS} SELECT event_id, value FROM log, bounds WHERE value < low OR value > high"
_FLAGS = f"""{_BOUNDS}, {_runs('entity_id', 3)}, again_ids AS (SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, event_type, value, run) AS size FROM (SELECT *, sum(opens) OVER (PARTITION BY entity_id, event_type, value ORDER BY ms, source_row) AS run FROM
(SELECT *, CASE WHEN ms - lag(ms) OVER w > 300000 OR lag(ms) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM ms WINDOW w AS (PARTITION BY entity_id, event_type, value ORDER BY ms, source_row)))) WHERE size >= 2),
rare AS (SELECT event_type FROM log GROUP BY 1 HAVING count(*) <= greatest(1, floor((SELECT count(*) FROM log) * 0.05))),
notable AS (SELECT * FROM (SELECT log.*, array_to_string(list_filter([CASE WHEN event_type IN (SELECT event_type FROM rare) THEN 'rare' END, CASE WHEN event_id IN (SELECT event_id FROM log, bounds WHERE value < low OR value > high) THEN 'odd' END,
CASE WHEN event_id IN (SELECT event_id FROM runs) THEN 'burst' END, CASE WHEN event_id IN (SELECT event_id FROM again_ids) THEN 'again' END], lambda x: x IS NOT NULL), ',') AS reasons FROM log) WHERE reasons <> '')"""
QUERIES["notable_events"] = lambda s, d: E.notable(_log(s, d)).select("event_id", "entity_id", F.array_join("reasons", ",").alias("reasons"))
SQL["notable_events"] = f"{_LOG}, {_FLAGS} SELECT event_id, entity_id, reasons FROM notable"
QUERIES["highlighted_entities"] = lambda s, d: _longs(E.highlighted(_log(s, d)), "n", "notable").select("entity_id", "n", "notable")
SQL["highlighted_entities"] = f"{_LOG}, {_FLAGS}, c AS (SELECT entity_id, count(*) AS n FROM log GROUP BY 1), m AS (SELECT entity_id, count(*) AS k FROM notable GROUP BY 1) SELECT entity_id, CAST(n AS BIGINT) AS n, CAST(coalesce(k, 0) AS BIGINT) AS notable FROM c LEFT JOIN m USING (entity_id) WHERE n > (SELECT median(n) FROM c) OR k > 0"
QUERIES["event_lookup"] = lambda s, d: _log(s, d).filter("event_id = '17'").select("event_id", "entity_id", "event_type", "value")
SQL["event_lookup"] = f"{_LOG} SELECT event_id, entity_id, event_type, value FROM log WHERE event_id = '17'"
QUERIES["entity_lookup"] = lambda s, d: _longs(E.entity_detail(_log(s, d), "7"), "n", "clusters")
SQL["entity_lookup"] = f"""{_LOG}, {_FLAGS}, c AS (SELECT entity_id, count(*) AS n FROM log GROUP BY 1), {_runs('entity_id', 2).replace('o AS', 'o2 AS').replace('r AS', 'r2 AS').replace('FROM o)', 'FROM o2)').replace('z AS', 'z2 AS').replace('FROM r)', 'FROM r2)').replace('runs AS', 'near AS').replace('FROM z WHERE', 'FROM z2 WHERE')}
SELECT entity_id, CAST(count(*) AS BIGINT) AS n, min(ms) AS first_ms, max(ms) AS last_ms, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, (SELECT coalesce(string_agg(event_id, ',' ORDER BY event_id), '') FROM notable WHERE entity_id = '7') AS notable,
(SELECT CAST(count(DISTINCT run) AS BIGINT) FROM near WHERE entity_id = '7') AS clusters, array_to_string(list_filter([CASE WHEN count(*) > (SELECT median(n) FROM c) THEN 'busy' END, CASE WHEN EXISTS (SELECT 1 FROM notable WHERE entity_id = '7') THEN 'notable' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ms WHERE entity_id = '7' GROUP BY entity_id"""
QUERIES["median_gap"] = lambda s, d: E.median_gap(_log(s, d))
SQL["median_gap"] = f"{_LOG} SELECT median(gap) AS median_gap_ms FROM (SELECT ms - lag(ms) OVER (ORDER BY ms, source_row) AS gap FROM ms)"

# -- cross-section ---------------------------------------------------------

_NUMERIC = ("balance", "n_orders", "spent", "priorities")
_CATEGORIES = ("segment", "region")


def _long_numbers(s: SparkSession, d: str) -> DataFrame:
    return V.customers(s, d).select("customer_id", *_NUMERIC).unpivot("customer_id", list(_NUMERIC), "name", "x")


_CS = f"WITH {V.CUSTOMERS_SQL}, nums AS (SELECT customer_id, name, x FROM customers CROSS JOIN LATERAL (VALUES ('balance', balance), ('n_orders', n_orders), ('spent', spent), ('priorities', priorities)) t(name, x)), cats AS (SELECT customer_id, name, x FROM customers CROSS JOIN LATERAL (VALUES ('segment', segment), ('region', region)) t(name, x))"
QUERIES["numeric_summary"] = lambda s, d: _numeric_summary(_long_numbers(s, d))


def _numeric_summary(long: DataFrame) -> DataFrame:
    """Counts, bounds and moments by column, and the median from ranks."""
    stats = long.groupBy("name").agg(F.count("x").cast("bigint").alias("n"), F.count_if(F.col("x").isNull()).cast("bigint").alias("missing"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("deviation"))
    return stats.join(medians(long, "x", ["name"]).withColumn("median", F.round("median", 4)), "name", "left")


SQL["numeric_summary"] = f"{_CS} SELECT name, CAST(count(x) AS BIGINT) AS n, CAST(count(*) - count(x) AS BIGINT) AS missing, min(x) AS low, max(x) AS high, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_pop(x), 4) AS deviation FROM nums GROUP BY 1"
QUERIES["categorical_summary"] = lambda s, d: V.customers(s, d).select("customer_id", *_CATEGORIES).unpivot("customer_id", list(_CATEGORIES), "name", "x").groupBy("name", "x").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
SQL["categorical_summary"] = f"{_CS} SELECT name, x, CAST(count(*) AS BIGINT) AS n FROM cats GROUP BY ALL"
QUERIES["group_mean_range"] = lambda s, d: _mean_range(V.customers(s, d), "segment", "spent")
QUERIES["numeric_by_target_group"] = lambda s, d: _mean_range(V.customers(s, d), "region", "balance")


def _mean_range(df: DataFrame, by: str, value: str) -> DataFrame:
    """Spread of group means against the deviation of all values."""
    means = df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    spread = df.agg(F.stddev_pop(value).alias("sd"))
    return means.agg(F.sum("n").cast("bigint").alias("n"), (F.max("mean") - F.min("mean")).alias("reach")).join(F.broadcast(spread)).select("n", F.round(F.coalesce(F.try_divide("reach", "sd"), F.lit(0.0)), 6).alias("strength"))


for _name, _by, _value in (("group_mean_range", "segment", "spent"), ("numeric_by_target_group", "region", "balance")):
    SQL[_name] = f"{_CS}, g AS (SELECT count(*) AS n, avg({_value}) AS m FROM customers WHERE {_value} IS NOT NULL AND {_by} IS NOT NULL GROUP BY {_by}) SELECT CAST(sum(n) AS BIGINT) AS n, round((max(m) - min(m)) / (SELECT stddev_pop({_value}) FROM customers), 6) AS strength FROM g"
QUERIES["contingency"] = lambda s, d: V.customers(s, d).groupBy("segment", "region").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
SQL["contingency"] = f"{_CS} SELECT segment, region, CAST(count(*) AS BIGINT) AS n FROM customers GROUP BY ALL"
QUERIES["pearson"] = lambda s, d: V.customers(s, d).filter("spent is not null and n_orders is not null").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.round(pearson(F.col("n_orders"), F.col("spent")), 6).alias("r"))
SQL["pearson"] = f"{_CS} SELECT CAST(count(*) AS BIGINT) AS n, round(covar_pop(n_orders, spent) / (stddev_pop(n_orders) * stddev_pop(spent)), 6) AS r FROM customers WHERE spent IS NOT NULL AND n_orders IS NOT NULL"
QUERIES["high_risk_numeric"] = lambda s, d: _at_least_p75(V.customers(s, d))


#: Context flags and their bounds; they do not change the ranking.
_CONTEXT = {"dti": "dti >= 0.4", "current": "current > 0", "history": "history > 0", "rating": "rating < 600"}
_CONTEXT_COLUMNS = {"dti": "round(abs(balance) / 10000, 4)", "current": "CASE WHEN balance < 0 THEN 1 ELSE 0 END", "history": "customer_id % 3", "rating": "500 + customer_id % 300"}


def _at_least_p75(df: DataFrame) -> DataFrame:
    """Rows at or above the value at place ceil(3n/4), with their context flags."""
    bound = values_at(df, "spent", {"bound": lambda n: F.ceil(n * 0.75) - 1})
    flags = F.array_join(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in _CONTEXT.items()])), ",")
    rows = df.withColumns({name: F.expr(e) for name, e in _CONTEXT_COLUMNS.items()}).join(F.broadcast(bound))
    return rows.filter("spent >= bound").select("customer_id", "spent", "bound", flags.alias("flags"))


SQL["high_risk_numeric"] = f"""{_CS}, s AS (SELECT list_sort(list(spent)) AS v, count(spent) AS n FROM customers WHERE spent IS NOT NULL), b AS (SELECT v[CAST(ceil(n * 0.75) AS INTEGER)] AS bound FROM s),
f AS (SELECT *, {", ".join(f"{e} AS {name}" for name, e in _CONTEXT_COLUMNS.items())} FROM customers)
SELECT customer_id, spent, bound, array_to_string(list_filter([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _CONTEXT.items())}], lambda x: x IS NOT NULL), ',') AS flags FROM f, b WHERE spent >= bound"""
#: Labels of high risk.
_HIGH = ("HIGH", "HIGH_RISK", "CRITICAL", "YES", "TRUE", "1", "ВЫСОКИЙ", "КРИТИЧЕСКИЙ", "ДА")
#: Orders with a label each, in every spelling.
_LABELLED = "element_at(array('high', 'Low', 'critical', 'High_Risk', 'no', 'yes', 'true', '1', 'высокий', 'средний', 'Критический', 'да'), cast(o_orderkey % 12 as int) + 1)"
QUERIES["high_risk_categorical"] = lambda s, d: V.table(s, d, "orders").withColumn("label", F.expr(_LABELLED)).filter(F.upper("label").isin(*_HIGH)).select("o_orderkey", "label")
SQL["high_risk_categorical"] = f"SELECT o_orderkey, label FROM (SELECT o_orderkey, {_LABELLED.replace('element_at(array(', '([').replace('), cast(o_orderkey % 12 as int) + 1)', '])[o_orderkey % 12 + 1]')} AS label FROM orders) WHERE upper(label) IN {_HIGH}"
QUERIES["prevalence"] = lambda s, d: V.customers(s, d).agg(F.round(F.avg((F.coalesce("n_orders", F.lit(0.0)) > 10).cast("double")), 9).alias("rate"))
SQL["prevalence"] = f"{_CS} SELECT round(avg(CASE WHEN coalesce(n_orders, 0) > 10 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM customers"

# -- series ----------------------------------------------------------------


def _series(s: SparkSession, d: str) -> DataFrame:
    """signal, idx, x, n_rows.  A series is a few thousand rows at most: one a week."""
    rows = V.weekly(s, d).withColumn("idx", F.row_number().over(Window.orderBy("week")) - 1)
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("idx", *V.WEEKLY).unpivot("idx", list(V.WEEKLY), "signal", "x").join(F.broadcast(total))


_TS = f"WITH {V.WEEKLY_SQL}"
QUERIES["generic_finding"] = lambda s, d: _findings(_series(s, d))


def _findings(long: DataFrame) -> DataFrame:
    stats = long.groupBy("signal").agg(F.count("x").cast("bigint").alias("n"), F.max_by("x", "idx").alias("latest"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return stats.filter("n >= 3").select("signal", "n", F.round("latest", 4).alias("latest"), F.round(F.try_divide(F.col("latest") - F.col("mean"), "sd"), 6).alias("z")).filter("abs(z) >= 1")


SQL["generic_finding"] = f"{_TS} SELECT * FROM (SELECT signal, CAST(count(x) AS BIGINT) AS n, round(arg_max(x, idx), 4) AS latest, round((arg_max(x, idx) - avg(x)) / nullif(stddev_pop(x), 0), 6) AS z FROM long GROUP BY 1) WHERE n >= 3 AND abs(z) >= 1"
QUERIES["inspect_series"] = lambda s, d: _series(s, d).groupBy("signal").agg(F.count("x").cast("bigint").alias("n"), F.round(F.max_by("x", "idx"), 4).alias("latest"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("sd"))
SQL["inspect_series"] = f"{_TS} SELECT signal, CAST(count(x) AS BIGINT) AS n, round(arg_max(x, idx), 4) AS latest, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd FROM long GROUP BY 1"
QUERIES["zscore_outlier_count"] = lambda s, d: _series(s, d).withColumns({"m": F.avg("x").over(Window.partitionBy("signal")), "sd": F.stddev_pop("x").over(Window.partitionBy("signal"))}).groupBy("signal").agg(F.count_if(F.abs(F.try_divide(F.col("x") - F.col("m"), "sd")) >= 1.5).cast("bigint").alias("n"))
SQL["zscore_outlier_count"] = f"{_TS} SELECT signal, CAST(count(*) FILTER (abs(z) >= 1.5) AS BIGINT) AS n FROM (SELECT signal, (x - avg(x) OVER (PARTITION BY signal)) / nullif(stddev_pop(x) OVER (PARTITION BY signal), 0) AS z FROM long) GROUP BY 1"
def _trail(c: Column) -> Column:
    """An aggregate over a row and the three before it."""
    return c.over(Window.partitionBy("signal").orderBy("idx").rowsBetween(-3, 0))


def _z_of() -> Column:
    """The distance of a value from its series' mean in deviations; 0 where there is none."""
    every = Window.partitionBy("signal")
    return F.coalesce(F.try_divide(F.col("x") - F.avg("x").over(every), F.stddev_pop("x").over(every)), F.lit(0.0))


QUERIES["rolling_statistics"] = lambda s, d: _series(s, d).select("signal", F.col("idx").cast("bigint").alias("idx"), F.round(_trail(F.avg("x")), 6).alias("mean"), F.round(_trail(F.stddev_pop("x")), 1).alias("deviation"))
SQL["rolling_statistics"] = f"{_TS} SELECT signal, CAST(idx AS BIGINT) AS idx, round(avg(x) OVER w, 6) AS mean, round(stddev_pop(x) OVER w, 1) AS deviation FROM long WINDOW w AS (PARTITION BY signal ORDER BY idx ROWS 3 PRECEDING)"
QUERIES["percentage_change"] = lambda s, d: _series(s, d).withColumn("p", F.lag("x").over(Window.partitionBy("signal").orderBy("idx"))).select("signal", F.col("idx").cast("bigint").alias("idx"), F.round(percentage_change(F.col("p"), F.col("x")), 6).alias("change"))
SQL["percentage_change"] = f"{_TS} SELECT signal, CAST(idx AS BIGINT) AS idx, round(CASE WHEN p = 0 THEN 0 ELSE (x - p) / abs(p) END, 6) AS change FROM (SELECT *, lag(x) OVER (PARTITION BY signal ORDER BY idx) AS p FROM long)"
_Z_SQL = "coalesce((x - avg(x) OVER (PARTITION BY signal)) / nullif(stddev_pop(x) OVER (PARTITION BY signal), 0), 0)"
QUERIES["z_score"] = lambda s, d: _series(s, d).select("signal", F.col("idx").cast("bigint").alias("idx"), F.round(_z_of(), 6).alias("z"))
SQL["z_score"] = f"{_TS} SELECT signal, CAST(idx AS BIGINT) AS idx, round({_Z_SQL}, 6) AS z FROM long"
QUERIES["anomaly_score"] = lambda s, d: _series(s, d).select("signal", F.col("idx").cast("bigint").alias("idx"), F.round(clamp(F.abs(_z_of()) / 20, 0.0, 1.0), 6).alias("score"))
SQL["anomaly_score"] = f"{_TS} SELECT signal, CAST(idx AS BIGINT) AS idx, round(least(1.0, greatest(0.0, abs({_Z_SQL}) / 20)), 6) AS score FROM long"
QUERIES["temporal_consistency"] = lambda s, d: _consistency(_series(s, d))


def _consistency(long: DataFrame) -> DataFrame:
    """Shares of steps that do not fall, and that do not rise; 0 below two values."""
    steps = long.withColumn("p", F.lag("x").over(Window.partitionBy("signal").orderBy("idx")))
    share = lambda held: F.round(F.coalesce(F.try_divide(F.count_if(held), F.count("p")), F.lit(0.0)), 6)
    return steps.groupBy("signal").agg(share(F.col("x") >= F.col("p")).alias("rising"), share(F.col("x") <= F.col("p")).alias("falling"))


SQL["temporal_consistency"] = f"{_TS} SELECT signal, round(coalesce(CAST(count(*) FILTER (x >= p) AS DOUBLE) / nullif(count(p), 0), 0), 6) AS rising, round(coalesce(CAST(count(*) FILTER (x <= p) AS DOUBLE) / nullif(count(p), 0), 0), 6) AS falling FROM (SELECT *, lag(x) OVER (PARTITION BY signal ORDER BY idx) AS p FROM long) GROUP BY 1"
QUERIES["top3_candidates"] = lambda s, d: _findings(_series(s, d)).orderBy(F.desc(F.abs("z")), "signal").limit(3).select("signal", "z")
SQL["top3_candidates"] = f"{SQL['generic_finding'].replace('SELECT * FROM', 'SELECT signal, z FROM', 1)} ORDER BY abs(z) DESC, signal LIMIT 3"
QUERIES["directional_movement"] = lambda s, d: _moves(_series(s, d))


def _moves(long: DataFrame) -> DataFrame:
    order = Window.partitionBy("signal").orderBy("idx")
    last = long.withColumns({"back": F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("idx"))), "p": F.lag("x").over(order)})
    return last.filter("back <= 5").groupBy("signal").agg(F.count_if(F.col("x") >= F.col("p")).cast("bigint").alias("rising"))


SQL["directional_movement"] = f"{_TS} SELECT signal, CAST(count(*) FILTER (x >= p) AS BIGINT) AS rising FROM (SELECT *, lag(x) OVER (PARTITION BY signal ORDER BY idx) AS p, row_number() OVER (PARTITION BY signal ORDER BY idx DESC) AS back FROM long) WHERE back <= 5 GROUP BY 1"


def _lags(s: SparkSession, d: str, anchor: str = "revenue") -> DataFrame:
    """Correlation of each signal with the anchor at lags 0 to 3, on true row numbers."""
    long = _series(s, d)
    target = long.filter(F.col("signal") == anchor).select(F.col("idx").alias("at"), F.col("x").alias("y"))
    moved = long.filter(F.col("signal") != anchor).withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.floor(F.col("n_rows") / 4)).cast("int"))))
    pairs = moved.join(target, F.col("idx") + F.col("lag") == F.col("at")).filter("x is not null and y is not null")
    found = pairs.groupBy("signal", "lag").agg(F.count(F.lit(1)).cast("bigint").alias("n"), pearson(F.col("x"), F.col("y")).alias("r"))
    short = F.min(F.when(F.col("n") < 5, F.col("lag"))).over(Window.partitionBy("signal"))
    return found.withColumn("short", short).filter("short is null or lag < short").drop("short").withColumn("lag", F.col("lag").cast("bigint"))


_LAGS = f"""{_TS}, found AS (SELECT l.signal, k.lag, count(*) AS n, coalesce(covar_pop(l.x, t.x) / nullif(stddev_pop(l.x) * stddev_pop(t.x), 0), 0) AS r
FROM long l CROSS JOIN (SELECT unnest(range(4)) AS lag) k JOIN long t ON t.signal = 'revenue' AND t.idx = l.idx + k.lag WHERE l.signal <> 'revenue' AND k.lag <= floor(l.n_rows / 4) GROUP BY ALL)"""
QUERIES["lag_scan"] = lambda s, d: _lags(s, d).select("signal", "lag", "n", F.round("r", 6).alias("r"))
SQL["lag_scan"] = f"{_LAGS} SELECT signal, CAST(lag AS BIGINT) AS lag, CAST(n AS BIGINT) AS n, round(r, 6) AS r FROM found"
_BEST = "best AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY abs(r) DESC, lag) AS k FROM found)"


def _strongest(s: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("lag", "n", "r"), F.struct(F.abs("r"), -F.col("lag")))
    return _lags(s, d).groupBy("signal").agg(best.alias("b")).select("signal", "b.*")


QUERIES["strongest_lag"] = lambda s, d: _strongest(s, d).select("signal", "lag", F.round("r", 6).alias("r"))
SQL["strongest_lag"] = f"{_LAGS}, {_BEST} SELECT signal, CAST(lag AS BIGINT) AS lag, round(r, 6) AS r FROM best WHERE k = 1"


def _fisher(s: SparkSession, d: str) -> DataFrame:
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r")))
    z, se = F.log((1 + r) / (1 - r)) * 0.5, F.lit(1.959963985) / F.sqrt(F.col("n") - 3)
    return _strongest(s, d).filter("n >= 6").select("signal", F.round(F.tanh(z - se), 6).alias("low"), F.round(F.tanh(z + se), 6).alias("high"))


QUERIES["fisher_ci"] = _fisher
SQL["fisher_ci"] = f"{_LAGS}, {_BEST}, c AS (SELECT signal, n, greatest(-0.999999, least(0.999999, r)) AS r FROM best WHERE k = 1 AND n >= 6) SELECT signal, round(tanh(0.5 * ln((1 + r) / (1 - r)) - CAST(1.959963985 AS DOUBLE) / sqrt(n - 3)), 6) AS low, round(tanh(0.5 * ln((1 + r) / (1 - r)) + CAST(1.959963985 AS DOUBLE) / sqrt(n - 3)), 6) AS high FROM c"
QUERIES["risk_indicator"] = lambda s, d: _strongest(s, d).orderBy(F.desc(F.abs("r")), "signal").limit(5).agg((F.avg(F.abs("r")) * F.least(F.lit(1.0), F.min("n") / 30)).alias("risk")).select(F.round("risk", 6).alias("risk"), F.when(F.col("risk") < 0.33, "LOW").when(F.col("risk") < 0.66, "MEDIUM").otherwise("HIGH").alias("label"))
SQL["risk_indicator"] = f"{_LAGS}, {_BEST}, t AS (SELECT * FROM best WHERE k = 1 ORDER BY abs(r) DESC, signal LIMIT 5), x AS (SELECT avg(abs(r)) * least(1, min(n) / 30) AS risk FROM t) SELECT round(risk, 6) AS risk, CASE WHEN risk < 0.33 THEN 'LOW' WHEN risk < 0.66 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM x"
