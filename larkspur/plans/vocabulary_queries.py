"""Queries that read names and cells of the tables against the vocabulary of the domains."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.checkpoints import kept
from larkspur.functions.columns import numeric_cell
from larkspur.operators import catalog as C
from larkspur.operators import vocabulary as W
from larkspur.operators.profile import period_time
from larkspur.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: All names of the vocabulary in their order, from which uploads take their headers.
_NAMES = [(k, domain, metric, alias) for k, (domain, metric, alias) in enumerate((m[0], m[1], a) for m in C.metrics() for a in m[6])]


def _spelled(c, k):
    """A name as an upload may spell it."""
    return F.when(k % 7 == 1, F.upper(c)).when(k % 7 == 2, F.replace(c, F.lit(" "), F.lit("_"))).when(k % 7 == 3, F.concat(c, F.lit(" (2000)"))).when(k % 7 == 4, F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit(" - ")))).when(k % 7 == 5, F.concat(c, F.lit(" old"))).otherwise(c)


_SPELLED = "CASE WHEN k % 7 = 1 THEN upper(a) WHEN k % 7 = 2 THEN replace(a, ' ', '_') WHEN k % 7 = 3 THEN a || ' (2000)' WHEN k % 7 = 4 THEN ' ' || replace(a, ' ', ' - ') WHEN k % 7 = 5 THEN a || ' old' ELSE a END"


def headers(s: SparkSession, d: str) -> DataFrame:
    """Every order is an uploaded table; each of its lines names one column."""
    names = s.createDataFrame([(k, alias) for k, _, _, alias in _NAMES], "place int, alias string")
    items = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = F.col("l_partkey") + F.col("l_linenumber")
    place = F.pmod(F.col("l_orderkey") % 4 * F.lit(len(_NAMES) // 4) + F.col("l_partkey") % 40, F.lit(len(_NAMES))).cast("int")
    return items.withColumn("place", place).join(F.broadcast(names), "place").select(F.col("l_orderkey").alias("table"), _spelled(F.col("alias"), k).alias("name"))


_VALUES = ", ".join(f"({k}, '{domain}', '{metric}', '{alias}')" for k, domain, metric, alias in _NAMES)
_MARKED = ", ".join(f"('{d}', '{m}', {mark == 'strong'}, {mark == 'characteristic'}, {mark == 'outcome'})" for d, marks in C.MARKS.items() for mark, ms in marks.items() for m in ms)
_HEADERS = f"""WITH names AS (SELECT * FROM (VALUES {_VALUES}) t(place, domain, metric, alias)), marked AS (SELECT domain, metric, bool_or(strong) AS strong, bool_or(characteristic) AS characteristic, bool_or(outcome) AS outcome FROM (VALUES {_MARKED}) t(domain, metric, strong, characteristic, outcome) GROUP BY 1, 2),
heads AS (SELECT l_orderkey AS "table", {_SPELLED} AS name FROM (SELECT l_orderkey, l_partkey + l_linenumber AS k, alias AS a FROM lineitem JOIN names ON place = (l_orderkey % 4 * {len(_NAMES) // 4} + l_partkey % 40) % {len(_NAMES)}))"""
_KEY = "trim(regexp_replace(replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), 'ё', 'е'), '[\\p{{Pd}}_/(),.;:«»\"''!?\\s]+', ' ', 'g'))"
QUERIES["upload_domains"] = lambda s, d: W.resolve_schemas(headers(s, d), C.aliases(s), C.hints(s), ["table"]).select("table", "domain", *[F.col(c).cast("bigint").alias(c) for c in ("metrics", "score")], "eligible", "status")
SQL["upload_domains"] = f"""{_HEADERS}, words AS (SELECT DISTINCT domain, metric, {_KEY.format('alias')} AS key FROM names), m AS (SELECT DISTINCT "table", domain, metric FROM (SELECT "table", {_KEY.format('name')} AS key FROM heads) JOIN words USING (key)),
s AS (SELECT "table", domain, count(*) AS metrics, 2 * count(*) + 5 * count(*) FILTER (strong) + 3 * count(*) FILTER (characteristic) + count(*) FILTER (outcome) AS score, count(*) >= 3 AND (count(*) FILTER (strong) >= 1 OR count(*) FILTER (characteristic) >= 2) AS eligible FROM m LEFT JOIN marked USING (domain, metric) GROUP BY 1, 2),
b AS (SELECT "table", domain FROM s WHERE eligible QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY score DESC, domain) = 1), n AS (SELECT s."table", max(score) AS next FROM s JOIN b ON s."table" = b."table" AND s.domain <> b.domain GROUP BY 1)
SELECT s."table", s.domain, metrics, score, eligible, CASE WHEN b.domain IS NOT NULL THEN CASE WHEN score - next < 3 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END END AS status FROM s LEFT JOIN b ON s."table" = b."table" AND s.domain = b.domain LEFT JOIN n ON n."table" = s."table\""""
QUERIES["column_concepts"] = lambda s, d: W.resolve_columns(headers(s, d), C.concepts(s)).select("name", "normalized", "method", "concept", F.array_join("candidates", ",").alias("candidates"))
_CONCEPT = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[\\p{{Pd}}−_(),.%/;:«»\"№''\\s]+', ' ', 'g'))"
SQL["column_concepts"] = f"""{_HEADERS}, asked AS (SELECT DISTINCT name, {_CONCEPT.format('name')} AS normalized FROM heads), free AS (SELECT * FROM asked WHERE normalized <> '' AND normalized NOT IN {W.VAGUE}),
al AS (SELECT DISTINCT metric AS concept, alias, {_CONCEPT.format('alias')} AS key FROM names WHERE alias <> metric),
hit AS (SELECT name, 0 AS stage, concept, length(name) AS n FROM free JOIN (SELECT DISTINCT metric AS concept FROM names) c ON name = concept UNION ALL SELECT name, 1, concept, length(key) FROM free JOIN al ON name = alias
UNION ALL SELECT name, 2, concept, length(key) FROM free JOIN al ON normalized = key UNION ALL SELECT name, 3, concept, length(key) FROM free JOIN al ON length(key) >= 6 AND starts_with(normalized, key || ' ')),
g AS (SELECT name, stage, n, list_sort(list(DISTINCT concept)) AS cs FROM hit GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY stage, n DESC) = 1)
SELECT name, normalized, CASE WHEN cs IS NULL THEN 'UNRESOLVED' WHEN len(cs) > 1 THEN 'AMBIGUOUS' ELSE ['EXACT_CANONICAL', 'EXACT_ALIAS', 'NORMALIZED_ALIAS', 'PREFIX_ALIAS'][stage + 1] END AS method, CASE WHEN len(cs) = 1 THEN cs[1] END AS concept, coalesce(array_to_string(cs, ','), '') AS candidates FROM asked LEFT JOIN g USING (name)"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
_OBJECTIVE = "cost and price of customer orders, days in transit, discount percent, quantity delivered, balance"


def columns(s: SparkSession, d: str) -> DataFrame:
    """table, name, context and facts of the cells of every column: one aggregate a table."""

    def of_table(table: str) -> DataFrame:
        df = V.table(s, d, table)
        cells, made = [], []
        for k, c in enumerate(df.columns):
            cell, kind = F.col(c).cast("string"), df.schema[c].dataType
            here = cell.isNotNull() & (F.trim(cell) != "")
            # Numbers and dates begin with digits; no other text is looked at any further.
            digits = here & cell.rlike(r"^\s*[+-]?\.?[0-9]")
            number, text = isinstance(kind, T.NumericType), isinstance(kind, T.StringType)
            cells += [
                here.alias(f"h{k}"),
                F.xxhash64(cell).alias(f"v{k}"),
                (F.col(c).cast("double") if number else F.when(digits, numeric_cell(cell)) if text else F.lit(None).cast("double")).alias(f"x{k}"),
                (F.lit(False) if number else F.coalesce(digits & period_time(cell).isNotNull(), F.lit(False)) if text else here).alias(f"d{k}"),
            ]
            around = [*df.columns[max(0, k - 2) : k], *df.columns[k + 1 : k + 3]]
            h, v, x = (F.col(f"{name}{k}") for name in "hvx")
            made.append(
                F.struct(
                    F.lit(c).alias("name"),
                    F.lit(" ".join([_OBJECTIVE, *around])).alias("context"),
                    F.count_if(h).alias("n"),
                    F.count(F.lit(1)).alias("n_rows"),
                    F.approx_count_distinct(F.when(h, v), 0.02).alias("unique"),
                    F.count(x).alias("numbers"),
                    F.count_if(F.col(f"d{k}")).alias("dates"),
                    F.coalesce(F.bool_and(x >= 0), F.lit(True)).alias("positive"),
                    F.coalesce(F.bool_and(F.abs(x - F.round(x)) <= 1e-9), F.lit(True)).alias("whole"),
                    F.max(x).alias("high"),
                    F.when(F.count_if(h) == F.count(x), "numeric").otherwise("categorical").alias("kind"),
                )
            )
        return df.select(*cells).agg(F.array(*made).alias("c")).select(F.lit(table).alias("table"), F.explode("c").alias("c")).select("table", "c.*")

    # Some dozens of rows, which the short list reads twice.
    return kept(reduce(DataFrame.unionByName, [of_table(t) for t in _TABLES]))


QUERIES["semantic_shortlist"] = lambda s, d: W.shortlist(columns(s, d), C.concepts(s).filter("domain = 'RETAIL'"), ["table", "name"]).select("table", "name", "concept", F.col("score").cast("bigint").alias("score"), "rank")
_RETAIL = [m for m in C.metrics() if m[0] == "RETAIL"]
_SAID = ", ".join(f"('{m[1]}', '{m[4]}', '{' '.join([m[1], m[2], *m[6]])}')" for m in _RETAIL)
_UNITS = ", ".join(f"('{family}', '{w}')" for family, ws in W.UNIT_WORDS.items() for w in ws)
_CELLS = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", name, count(*) FILTER (trim(cell) <> '') AS n, count(TRY_CAST(cell AS DOUBLE)) AS numbers, coalesce(bool_and(TRY_CAST(cell AS DOUBLE) >= 0), true) AS positive, coalesce(bool_and(abs(TRY_CAST(cell AS DOUBLE) - round(TRY_CAST(cell AS DOUBLE))) <= 1e-9), true) AS whole, max(TRY_CAST(cell AS DOUBLE)) AS high
FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE cell) GROUP BY name"""
    for t in _TABLES
)
_ORDER = " UNION ALL ".join(f"""SELECT '{t}' AS "table", name, row_number() OVER () AS k FROM (SELECT column_name AS name FROM (DESCRIBE {t}))""" for t in _TABLES)
_WORD = "regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+')"
_WEAK = ", ".join(f"'{w}'" for w in W.WEAK)
SQL["semantic_shortlist"] = f"""WITH cell AS ({_CELLS}), o AS ({_ORDER}), c AS (SELECT "table", name, k, string_agg(name, ' ') OVER (PARTITION BY "table" ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM o),
con AS (SELECT * FROM (VALUES {_SAID}) t(concept, family, texts)), units AS (SELECT * FROM (VALUES {_UNITS}) t(family, word)),
names AS (SELECT * FROM (VALUES {_VALUES}) t(place, domain, metric, alias)), al AS (SELECT DISTINCT metric AS concept, alias, {_CONCEPT.format('alias')} AS key FROM names WHERE domain = 'RETAIL'),
open_ AS (SELECT *, {_CONCEPT.format('name')} AS normalized FROM c JOIN cell USING ("table", name) WHERE n > 0),
hit AS (SELECT "table", name FROM open_ JOIN al ON name = alias OR normalized = key OR (length(key) >= 6 AND starts_with(normalized, key || ' '))),
w AS (SELECT DISTINCT "table", name, word FROM (SELECT "table", name, unnest({_WORD.format(f"around || ' {_OBJECTIVE}'")}) AS word FROM open_ ANTI JOIN hit USING ("table", name)) WHERE length(word) >= 3 AND word NOT IN ({_WEAK})),
said AS (SELECT DISTINCT concept, unnest({_WORD.format('texts')}) AS word FROM con),
p AS (SELECT "table", name, concept, count(*) AS shared, 0 AS unit FROM w JOIN said USING (word) GROUP BY ALL UNION ALL SELECT DISTINCT "table", name, concept, 0, 1 FROM w JOIN units USING (word) JOIN con USING (family)),
s AS (SELECT "table", name, concept, sum(shared) + 3 * max(unit) AS score FROM p GROUP BY ALL),
f AS (SELECT s.* FROM s JOIN open_ USING ("table", name) JOIN con USING (concept) WHERE numbers > 0 AND NOT CASE family WHEN 'COUNT' THEN NOT (positive AND whole) WHEN 'DAYS' THEN NOT positive WHEN 'HOURS' THEN NOT positive WHEN 'PERCENTAGE' THEN NOT (positive AND high <= 100) ELSE false END),
u AS (SELECT *, count(*) OVER (PARTITION BY "table", name ORDER BY score DESC) AS upto FROM f WHERE score > 0)
SELECT "table", name, concept, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY "table", name ORDER BY score DESC, concept) AS rank FROM u WHERE upto <= 15"""
