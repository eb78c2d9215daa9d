"""Queries on identity, inference, scenarios and profiles, with their DuckDB twins where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import pearson
from larkspur.operators import identity as I
from larkspur.operators import inference, scenario, series
from larkspur.plans import investigation_queries as Q
from larkspur.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- product identity -------------------------------------------------------


def _parts(s: SparkSession, d: str) -> DataFrame:
    """A product's name, the same in another order of words, and with a letter lost."""
    size = F.col("p_size").cast("string")
    name = F.concat_ws(" ", "p_name", "p_type", size)
    turned = F.concat_ws(", ", "p_type", "p_name", size)
    lost = F.concat(F.substring(name, 1, 5), F.expr("substring(concat_ws(' ', p_name, p_type, cast(p_size as string)), 7)"))
    return V.table(s, d, "part").select("p_partkey", F.col("p_brand").alias("sku"), name.alias("product_name"), turned.alias("turned"), lost.alias("lost"))


def _named(parts: DataFrame, column: str) -> DataFrame:
    return parts.select(F.col(column).alias("product_name"))


def _mixed(parts: DataFrame) -> DataFrame:
    return parts.select(F.element_at(F.array("product_name", "turned", "lost"), (F.col("p_partkey") % 3 + 1).cast("int")).alias("product_name"))


_PARTS = r"""WITH names AS (SELECT p_partkey, p_brand AS sku, lower(p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR)) AS norm, lower(p_type || ', ' || p_name || ', ' || CAST(p_size AS VARCHAR)) AS turned FROM part),
more AS (SELECT *, substr(norm, 1, 5) || substr(norm, 7) AS lost FROM names),
ident AS (SELECT sku, norm, trim(regexp_replace(norm, '[^a-z0-9]+', ' ', 'g')) AS plain, array_to_string(list_sort(list_transform(regexp_extract_all(norm, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.'))), '|') AS numbers FROM more),
exact AS (SELECT norm, CASE WHEN min(sku) = max(sku) THEN min(sku) END AS sku FROM ident GROUP BY 1),
words AS (SELECT array_to_string(list_sort(string_split(plain, ' ')), ' ') AS words, CASE WHEN min(sku) = max(sku) THEN min(sku) END AS sku FROM ident GROUP BY 1),
probe AS (SELECT DISTINCT {probe} AS norm FROM more),
asked AS (SELECT norm, trim(regexp_replace(norm, '[^a-z0-9]+', ' ', 'g')) AS plain, array_to_string(list_sort(list_transform(regexp_extract_all(norm, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.'))), '|') AS numbers FROM probe),
scored AS (SELECT a.norm, i.sku, max(1 - CAST(levenshtein(a.plain, i.plain) AS DOUBLE) / greatest(length(a.plain), length(i.plain))) AS score
  FROM asked a JOIN (SELECT DISTINCT sku, plain, numbers FROM ident) i ON a.numbers = i.numbers WHERE length(a.plain) >= 20 AND len(string_split(a.plain, ' ')) >= 3 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS rival FROM scored WINDOW w AS (PARTITION BY norm ORDER BY score DESC)),
close AS (SELECT norm, CASE WHEN score - coalesce(rival, 0) >= CAST(0.03 AS DOUBLE) THEN sku END AS sku FROM ranked WHERE k = 1 AND score >= CAST(0.94 AS DOUBLE))
"""
QUERIES["identity_exact_join"] = lambda s, d: I.exact(_parts(s, d), _parts(s, d))
SQL["identity_exact_join"] = _PARTS.format(probe="norm") + "SELECT norm, sku FROM probe JOIN exact USING (norm)"
QUERIES["identity_token_join"] = lambda s, d: I.by_words(_named(_parts(s, d), "turned"), _parts(s, d))
SQL["identity_token_join"] = _PARTS.format(probe="turned") + "SELECT norm, words.sku FROM asked JOIN words ON array_to_string(list_sort(string_split(plain, ' ')), ' ') = words.words"
QUERIES["identity_fuzzy_join"] = lambda s, d: I.by_spelling(_named(_parts(s, d), "lost"), _parts(s, d))
SQL["identity_fuzzy_join"] = _PARTS.format(probe="lost") + "SELECT norm, sku FROM close"
QUERIES["identity_resolution"] = lambda s, d: I.resolve(_mixed(_parts(s, d)), _parts(s, d))
_MIXED = _PARTS.format(probe="[norm, turned, lost][p_partkey % 3 + 1]") + """, steps AS (SELECT a.norm, e.norm IS NOT NULL AS e, e.sku AS es, w.words IS NOT NULL AS w, w.sku AS ws, c.norm IS NOT NULL AS c, c.sku AS cs
FROM asked a LEFT JOIN exact e ON a.norm = e.norm LEFT JOIN words w ON array_to_string(list_sort(string_split(a.plain, ' ')), ' ') = w.words LEFT JOIN close c ON a.norm = c.norm) """
SQL["identity_resolution"] = _MIXED + "SELECT norm, e OR w OR c AS found, CASE WHEN e THEN es WHEN w THEN ws ELSE cs END AS sku FROM steps"
QUERIES["unmatched_distinct"] = lambda s, d: I.resolve(_mixed(_parts(s, d)), _parts(s, d)).filter("sku is null").select("norm")
SQL["unmatched_distinct"] = _MIXED + "SELECT norm FROM steps WHERE CASE WHEN e THEN es WHEN w THEN ws ELSE cs END IS NULL"

# -- inference --------------------------------------------------------------


def _p_values(s: SparkSession, d: str) -> DataFrame:
    return Q._lags(s, d).withColumn("p", inference.p_value(F.col("r"), F.col("n")))


QUERIES["pearson_p_value"] = lambda s, d: _p_values(s, d).select("signal", "lag", "n", F.round("p", 9).alias("p"))
QUERIES["holm"] = lambda s, d: inference.holm(_holm_rows(s, d), ["family"]).select("family", "lag", "significant")


def _holm_rows(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").cast("bigint").alias("lag"), ((F.col("p_partkey") * 7919) % 1000 / F.lit(20000.0)).alias("p"))


SQL["holm"] = """WITH t AS (SELECT p_brand AS family, CAST(p_partkey AS BIGINT) AS lag, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 20000 AS p FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, lag) AS k, count(*) OVER (PARTITION BY family) AS m FROM t)
SELECT family, lag, bool_and(p <= CAST(0.05 AS DOUBLE) / (m - k + 1)) OVER (PARTITION BY family ORDER BY p, lag ROWS UNBOUNDED PRECEDING) AS significant FROM o"""


def _pairs(s: SparkSession, d: str, anchor: str = "revenue") -> DataFrame:
    """signal, lag, idx, x, y: a signal's row with the anchor's row ``lag`` later."""
    long = Q._series(s, d)
    target = long.filter(F.col("signal") == anchor).select(F.col("idx").alias("at"), F.col("x").alias("y"))
    moved = long.filter(F.col("signal") != anchor).withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.floor(F.col("n_rows") / 4)).cast("int"))))
    joined = moved.join(target, F.col("idx") + F.col("lag") == F.col("at"))
    return joined.filter("x is not null and y is not null").select("signal", F.col("lag").cast("bigint").alias("lag"), F.col("idx").cast("bigint").alias("idx"), "x", "y")


QUERIES["lag_self_join"] = lambda s, d: _pairs(s, d).select("signal", "lag", "idx", "x", "y")
SQL["lag_self_join"] = f"WITH {V.WEEKLY_SQL} SELECT l.signal, CAST(k.lag AS BIGINT) AS lag, CAST(l.idx AS BIGINT) AS idx, l.x, t.x AS y FROM long l CROSS JOIN (SELECT unnest(range(4)) AS lag) k JOIN long t ON t.signal = 'revenue' AND t.idx = l.idx + k.lag WHERE l.signal <> 'revenue' AND k.lag <= floor(l.n_rows / 4)"


def _wide(s: SparkSession, d: str) -> DataFrame:
    """The weekly series with its running number; one row a week."""
    return V.weekly(s, d).withColumn("idx", F.row_number().over(Window.orderBy("week")) - 1)


def precursor_chain(s: SparkSession, d: str, target: str | None = None) -> DataFrame:
    """The strongest signals before the anchor, longest lag first, with significance and stability."""
    made = series.chain(_wide(s, d), list(V.WEEKLY), target)
    return made.select("signal", "anchor", "lag", "n", *[F.round(c, 6).alias(c) for c in ("r", "p", "low", "high", "median", "stable_low", "stable_high")], "significant", "stability").orderBy(F.desc("lag"), F.desc(F.abs("r")))


def _edges(s: SparkSession, d: str, target: str | None) -> DataFrame:
    wide = _wide(s, d)
    chosen = series.edges(series.lags(wide, list(V.WEEKLY), series.findings(wide, list(V.WEEKLY)), target))
    return chosen.crossJoin(F.broadcast(series.risk(chosen))).select("signal", "anchor", "lag", "n", *[F.round(c, 6).alias(c) for c in ("r", "low", "high", "risk")], "label")


QUERIES["precursor_chain"] = precursor_chain
QUERIES["precursor_edges"] = lambda s, d: _edges(s, d, None)
QUERIES["precursor_edges_of_target"] = lambda s, d: _edges(s, d, "customers")


def _edges_sql(target: str | None) -> str:
    return f"""WITH {V.WEEKLY_SQL}, f AS (SELECT signal, row_number() OVER (ORDER BY round(abs(z), 9) DESC, place) AS rank FROM (SELECT signal, list_position({list(V.WEEKLY)}, signal) AS place, coalesce((arg_max(x, idx) - avg(x)) / nullif(stddev_pop(x), 0), 0) AS z FROM long GROUP BY 1 HAVING count(x) >= 3) WHERE abs(z) >= 1),
a AS (SELECT {f"'{target}'" if target else "(SELECT signal FROM f WHERE rank = 1)"} AS anchor),
found AS (SELECT l.signal, anchor, k.lag, count(*) AS n, coalesce(covar_pop(l.x, t.x) / nullif(stddev_pop(l.x) * stddev_pop(t.x), 0), 0) AS r FROM long l JOIN f USING (signal) CROSS JOIN a CROSS JOIN (SELECT unnest(range(4)) AS lag) k JOIN long t ON t.signal = anchor AND t.idx = l.idx + k.lag
  WHERE l.signal <> anchor AND k.lag <= floor(l.n_rows / 4) GROUP BY ALL),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY signal ORDER BY round(abs(r), 12) DESC, lag) = 1), top AS (SELECT * FROM best ORDER BY round(abs(r), 9) DESC, signal LIMIT 5),
c AS (SELECT *, greatest(-0.999999, least(0.999999, r)) AS k FROM top), risk AS (SELECT least(1, greatest(0, avg(abs(r)) * least(1, min(n) / 30))) AS risk FROM top)
SELECT signal, anchor, CAST(lag AS BIGINT) AS lag, CAST(n AS BIGINT) AS n, round(r, 6) AS r, CASE WHEN n >= 6 THEN round(tanh(0.5 * ln((1 + k) / (1 - k)) - CAST(1.959963985 AS DOUBLE) / sqrt(n - 3)), 6) END AS low, CASE WHEN n >= 6 THEN round(tanh(0.5 * ln((1 + k) / (1 - k)) + CAST(1.959963985 AS DOUBLE) / sqrt(n - 3)), 6) END AS high,
  round(risk, 6) AS risk, CASE WHEN risk < 0.33 THEN 'LOW' WHEN risk < 0.66 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM c, risk"""


SQL["precursor_edges"] = _edges_sql(None)
SQL["precursor_edges_of_target"] = _edges_sql("customers")
QUERIES["bootstrap"] = lambda s, d: inference.bootstrap(_pairs(s, d), F.concat_ws("->", "signal", F.lit("revenue")))
_STRENGTH = ((0.2, "very weak"), (0.4, "weak"), (0.6, "moderate"), (0.8, "strong"))


def _strength(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.lit(False), "")
    for bound, text in _STRENGTH:
        label = label.when(F.abs("r") < bound, text)
    return Q._strongest(s, d).select("signal", label.otherwise("very strong").alias("strength"))


QUERIES["strength_class"] = _strength
SQL["strength_class"] = f"{Q._LAGS}, {Q._BEST} SELECT signal, CASE WHEN abs(r) < 0.2 THEN 'very weak' WHEN abs(r) < 0.4 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' WHEN abs(r) < 0.8 THEN 'strong' ELSE 'very strong' END AS strength FROM best WHERE k = 1"


def _correlations(s: SparkSession, d: str) -> DataFrame:
    """The five strongest correlations between the columns, in one pass over the wide rows."""
    weekly, names = V.weekly(s, d), V.WEEKLY
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    found = weekly.agg(*[pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    long = found.select(F.explode(F.array(*[F.struct(F.lit(min(a, b)).alias("a"), F.lit(max(a, b)).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("e")).select("e.*")
    return long.orderBy(F.desc(F.round(F.abs("r"), 9)), "a", "b").limit(5).select("a", "b", F.round("r", 6).alias("r"))


QUERIES["top5_correlations"] = _correlations
SQL["top5_correlations"] = f"WITH {V.WEEKLY_SQL}, c AS (SELECT l.signal AS a, t.signal AS b, covar_pop(l.x, t.x) / nullif(stddev_pop(l.x) * stddev_pop(t.x), 0) AS r FROM long l JOIN long t ON l.idx = t.idx AND l.signal < t.signal GROUP BY 1, 2) SELECT a, b, round(coalesce(r, 0), 6) AS r FROM c ORDER BY round(abs(coalesce(r, 0)), 9) DESC, a, b LIMIT 5"


def _cadence(s: SparkSession, d: str, days: DataFrame | None = None) -> DataFrame:
    """weekly if all gaps are 7 days, monthly if all are a month on the same or the
    last day, else unknown.  A series is a few thousand periods at most."""
    order = Window.orderBy("day")
    days = V.weekly(s, d).select(F.col("week").alias("day")) if days is None else days
    gaps = days.select("day", F.lag("day").over(order).alias("before")).filter("before is not null")
    month = (F.add_months("before", 1) == F.col("day")) | ((F.last_day("day") == F.col("day")) & (F.last_day(F.add_months("before", 1)) == F.col("day")))
    kind = F.when(F.count(F.lit(1)) == 0, "unknown").when(F.bool_and(F.date_diff("day", "before") == 7), "weekly").when(F.bool_and(month), "monthly").otherwise("unknown")
    return gaps.agg(F.count(F.lit(1)).cast("bigint").alias("gaps"), kind.alias("cadence"))


def _months(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("day")).distinct()


def _odd_days(s: SparkSession, d: str) -> DataFrame:
    return V.weekly(s, d).select(F.when(F.month("week") == 3, F.date_add("week", 1)).otherwise(F.col("week")).alias("day"))


QUERIES["cadence"] = lambda s, d: _cadence(s, d).withColumn("series", F.lit("week")).unionByName(_cadence(s, d, _months(s, d)).withColumn("series", F.lit("month"))).unionByName(_cadence(s, d, _odd_days(s, d)).withColumn("series", F.lit("odd")))
SQL["cadence"] = f"""WITH {V.WEEKLY_SQL}, days AS (SELECT 'week' AS series, week AS day FROM weekly UNION ALL SELECT DISTINCT 'month', last_day(o_orderdate) FROM orders UNION ALL SELECT 'odd', CASE WHEN month(week) = 3 THEN week + 1 ELSE week END FROM weekly),
g AS (SELECT series, day, lag(day) OVER (PARTITION BY series ORDER BY day) AS before FROM days)
SELECT series, CAST(count(before) AS BIGINT) AS gaps, CASE WHEN bool_and(date_diff('day', before, day) = 7) THEN 'weekly' WHEN bool_and(CAST(before + INTERVAL 1 MONTH AS DATE) = day OR (last_day(day) = day AND last_day(CAST(before + INTERVAL 1 MONTH AS DATE)) = day)) THEN 'monthly' ELSE 'unknown' END AS cadence FROM g WHERE before IS NOT NULL GROUP BY 1"""

# -- scenarios --------------------------------------------------------------

_NOTE = {"note": "worked example"}
FEWER_ORDERS = scenario.Scenario("n_orders", 0, 50, 10, False, (scenario.Effect("n_orders", "spent", 100000.0, **_NOTE), scenario.Effect("spent", "balance", 0.01, **_NOTE)), (scenario.Bound("spent", 0.0),), target="spent", threshold=500000.0)
_AFTER = ("n_orders_after", "spent_after", "balance_after")


def _grid(s: SparkSession, d: str) -> DataFrame:
    return scenario.sweep(V.customers(s, d).select("customer_id", "n_orders", "spent", "balance"), FEWER_ORDERS)


QUERIES["scenario_simulate"] = lambda s, d: _grid(s, d).select("customer_id", "change_pct", "available", "bounded", *[F.round(c, 4).alias(c) for c in _AFTER])
QUERIES["scenario_sweep"] = lambda s, d: scenario.recommend(V.customers(s, d).select("customer_id", "n_orders", "spent", "balance"), FEWER_ORDERS, "customer_id")
_GRID = f"""WITH {V.CUSTOMERS_SQL}, g AS (SELECT customer_id, n_orders, spent, balance, CAST(unnest([0, 10, 20, 30, 40, 50]) AS DOUBLE) AS change_pct FROM customers),
a AS (SELECT *, n_orders * (1 - change_pct / 100) AS n1 FROM g), b AS (SELECT *, spent + (n1 - n_orders) * 100000 AS free, greatest(CAST(0 AS DOUBLE), spent + (n1 - n_orders) * 100000) AS s1 FROM a),
c AS (SELECT *, balance + (s1 - spent) * CAST(0.01 AS DOUBLE) AS b1, coalesce(n_orders IS NOT NULL AND spent >= 0 AND balance IS NOT NULL, false) AS ok FROM b)"""
SQL["scenario_simulate"] = f"{_GRID} SELECT customer_id, change_pct, ok AS available, CASE WHEN ok THEN s1 <> free END AS bounded, CASE WHEN ok THEN round(n1, 4) END AS n_orders_after, CASE WHEN ok THEN round(s1, 4) END AS spent_after, CASE WHEN ok THEN round(b1, 4) END AS balance_after FROM c"
SQL["scenario_sweep"] = f"{_GRID}, r AS (SELECT customer_id, min(change_pct) FILTER (ok AND s1 <= 500000) AS change_pct, bool_or(ok) AS ok FROM c GROUP BY 1) SELECT customer_id, CASE WHEN change_pct IS NOT NULL THEN 'TARGET_REACHED' WHEN ok THEN 'TARGET_NOT_REACHED' ELSE 'NO_VALID_SCENARIO' END AS status, change_pct FROM r"

# -- profiles ---------------------------------------------------------------

_PROFILED = ("segment", "region", "balance", "n_orders", "spent", "priorities")


QUERIES["missing_count"] = lambda s, d: V.customers(s, d).agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in _PROFILED])
SQL["missing_count"] = f"WITH {V.CUSTOMERS_SQL} SELECT " + ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in _PROFILED) + " FROM customers"
QUERIES["numeric_pairs"] = lambda s, d: V.customers(s, d).filter("spent is not null and balance is not null").select("customer_id", "spent", "balance")
SQL["numeric_pairs"] = f"WITH {V.CUSTOMERS_SQL} SELECT customer_id, spent, balance FROM customers WHERE spent IS NOT NULL AND balance IS NOT NULL"


def _associations(s: SparkSession, d: str) -> DataFrame:
    """Each predictor's strength for ``spent``: |r| of numbers, spread of group means of classes."""
    rows = V.customers(s, d)
    numbers = ("balance", "n_orders", "priorities")
    wide = rows.agg(*[pearson(F.when(F.col(c).isNotNull(), F.col("spent")), F.when(F.col("spent").isNotNull(), F.col(c))).alias(c) for c in numbers])
    first = wide.select(F.explode(F.array(*[F.struct(F.lit(1).alias("method"), F.lit(c).alias("name"), F.abs(c).alias("strength")) for c in numbers])).alias("e")).select("e.*")
    classes = [Q._mean_range(rows, c, "spent").select(F.lit(2).alias("method"), F.lit(c).alias("name"), "strength") for c in ("segment", "region")]
    return first.unionByName(classes[0]).unionByName(classes[1])


QUERIES["associations"] = lambda s, d: _associations(s, d).select("method", "name", F.round("strength", 6).alias("strength"))
_ASSOCIATIONS = f"WITH {V.CUSTOMERS_SQL}, a AS (" + " UNION ALL ".join([f"SELECT 1 AS method, '{c}' AS name, coalesce(abs(covar_pop({c}, spent) / nullif(stddev_pop({c}) * stddev_pop(spent), 0)), 0) AS strength FROM customers WHERE {c} IS NOT NULL AND spent IS NOT NULL" for c in ("balance", "n_orders", "priorities")] + [f"SELECT 2, '{c}', (max(m) - min(m)) / (SELECT stddev_pop(spent) FROM customers) FROM (SELECT avg(spent) AS m FROM customers WHERE spent IS NOT NULL AND {c} IS NOT NULL GROUP BY {c})" for c in ("segment", "region")]) + ")"
SQL["associations"] = _ASSOCIATIONS + " SELECT method, name, round(strength, 6) AS strength FROM a"
QUERIES["top5_drivers"] = lambda s, d: _associations(s, d).orderBy("method", F.desc(F.round("strength", 6)), "name").limit(5).select("name")
SQL["top5_drivers"] = _ASSOCIATIONS + " SELECT name FROM a ORDER BY method, round(strength, 6) DESC, name LIMIT 5"
