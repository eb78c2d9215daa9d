"""Profiles, shapes and schemas of whole tables, each in one or two aggregations.

Cells of an uploaded table are text; a column is numeric, boolean, a date or a
category by what all of its cells are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import header_key, numeric_cell, present
from larkspur.functions.quantiles import medians

#: Words that make a column one of times, or of identifiers.
TIME_NAME = "date|time|timestamp|period"
ENTITY_NAME = r"(?i)^id$|_id$|^id_|client|customer|account|entity"


def cells(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """name, cell, at: every cell of the columns as text, with its row's place."""
    return table.select(F.col(order).alias("at"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("at", columns, "name", "cell")


def column_profile(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row a column: kind, missing and distinct values, first and last, moments."""
    long = cells(table, columns, order).withColumn("x", numeric_cell(F.col("cell")))
    here = present(F.col("cell"))
    dated = F.try_to_timestamp("cell").isNotNull()
    stats = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(here).alias("n"),
        F.count_if(~here | F.col("cell").isNull()).alias("missing"),
        F.count_distinct(F.when(here, F.col("cell"))).alias("unique"),
        F.min_by(F.when(here, F.col("cell")), F.when(here, F.col("at"))).alias("first"),
        F.max_by(F.when(here, F.col("cell")), F.when(here, F.col("at"))).alias("latest"),
        F.bool_and(F.when(here, F.col("cell").isin("true", "false"))).alias("truth"),
        F.count("x").alias("numbers"),
        F.bool_and(F.when(here, dated)).alias("dated"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("deviation"),
    )
    named_time = F.col("name").rlike(f"(?i){TIME_NAME}")
    kind = F.when(F.col("n") == 0, "empty").when(F.col("truth"), "boolean").when(F.col("numbers") == F.col("n"), "numeric").when(F.col("dated") & named_time, "datetime").otherwise("categorical")
    joined = stats.withColumn("kind", kind).join(medians(long, "x", ["name"]), "name", "left")
    numeric = F.col("kind") == "numeric"
    return joined.select("name", "kind", "n", "missing", F.round(F.col("missing") / F.col("n_rows") * 100, 6).alias("missing_percent"), "unique", "first", "latest", *[F.when(numeric, F.col(c)).alias(c) for c in ("low", "high", "mean", "median", "deviation")])


def dataset_profile(table: DataFrame, columns: list[str], profiled: DataFrame) -> DataFrame:
    """Rows, columns by kind, constant columns and rows that repeat another in every column."""
    repeats = table.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"))
    of = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("name")))), ",")
    kinds = profiled.agg(*[of(F.col("kind") == k).alias(k) for k in ("numeric", "categorical", "datetime")], of(F.col("unique") <= 1).alias("constant"), F.sum("missing").alias("missing"))
    return repeats.join(F.broadcast(kinds)).withColumn("n_columns", F.lit(len(columns)))


def period_time(c: Column) -> Column:
    """A calendar text as a time: a week, a month, day.month.year, or a date with or
    without a time.  Numbers are no dates."""
    week = F.regexp_extract(c, r"^(\d{4})-W(\d{2})$", 1)
    number = F.regexp_extract(c, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    fourth = F.to_date(F.concat(week, F.lit("-01-04")))
    monday = F.date_add(F.trunc(fourth, "week"), (number - 1) * 7)
    from_week = F.when((week != "") & number.between(1, 53) & (F.year(F.date_add(monday, 3)).cast("string") == week), monday.cast("timestamp"))
    from_month = F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(c, F.lit("-01")), F.lit("yyyy-MM-dd")))
    dotted = F.translate(c, "/", ".")
    from_day = F.when(c.rlike(r"^\d{1,2}([./])\d{1,2}\1\d{4}$"), F.try_to_timestamp(dotted, F.lit("d.M.yyyy")))
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.coalesce(F.when(week != "", from_week), from_month, from_day, F.when(iso, F.try_to_timestamp(c)))


def shape(table: DataFrame, columns: list[str], order: str, roles: dict[str, str]) -> DataFrame:
    """tag, time_column and measures of a table: events, entities, a series, or unclear.

    ``roles`` names the meaning of some columns (EVENT_ID, EVENT_TYPE, ENTITY_ID,
    EVENT_TIMESTAMP).  Whether periods rise is checked between neighbouring rows of
    the only column of times.
    """
    long = cells(table, columns, order)
    full = F.bool_and(present(F.col("cell")))
    facts = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        full.alias("full"),
        F.count_distinct("cell").alias("unique"),
        (F.bool_and(~present(F.col("cell")) | numeric_cell(F.col("cell")).isNotNull()) & (F.count(numeric_cell(F.col("cell"))) > 0)).alias("numeric"),
        F.bool_and(period_time(F.col("cell")).isNotNull() & F.col("cell").isNotNull()).alias("timed"),
    )
    role = F.coalesce(*[F.when(F.col("name") == c, F.lit(r)) for c, r in roles.items()], F.lit("")) if roles else F.lit("")
    facts = facts.withColumn("role", role)
    time_name = (F.col("role") == "EVENT_TIMESTAMP") | F.col("name").rlike(rf"(?i)^({TIME_NAME}|month|week|observation_date)$")
    entity_name = F.col("name").rlike(ENTITY_NAME)
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    seen = facts.agg(
        F.collect_list(F.when(F.col("timed") & time_name, F.col("name"))).alias("times"),
        F.array_sort(F.collect_list(F.when(F.col("numeric") & ~F.col("role").isin("EVENT_ID", "EVENT_TIMESTAMP", "ENTITY_ID") & ~entity_name & ~time_name, F.col("name")))).alias("measures"),
        has(F.col("full") & ((F.col("role") == "ENTITY_ID") | entity_name) & (F.col("unique") == F.col("n"))).alias("identity"),
        has(F.col("full") & (F.col("role") == "EVENT_ID")).alias("event_id"),
        has(F.col("full") & (F.col("role") == "ENTITY_ID")).alias("entity"),
        has(F.col("full") & (F.col("role") == "EVENT_TYPE")).alias("event_type"),
    ).withColumn("time_column", F.when(F.size("times") == 1, F.get("times", F.lit(0))))
    times = long.join(F.broadcast(seen.select(F.col("time_column").alias("name"))), "name").select("at", period_time(F.col("cell")).alias("t"))
    rises = times.agg((F.count("t") >= 3).alias("some"), F.max(F.struct("at", "t")).alias("_")).select("some").join(F.broadcast(_falls(times)))
    joined = seen.join(F.broadcast(rises), how="left")
    ordered = F.coalesce(F.col("some") & (F.col("falls") == 0), F.lit(False))
    timed = F.col("time_column").isNotNull()
    tag = (
        F.when(timed & F.col("event_type") & (F.col("event_id") | F.col("entity")), "EVENT_TRANSACTION")
        .when(F.col("identity") & ~F.col("event_type") & ~F.col("event_id"), "CROSS_SECTIONAL")
        .when(ordered & (F.size("measures") > 0) & ~F.col("event_type") & ~F.col("event_id") & ~F.col("entity"), "TIME_SERIES")
        .otherwise("AMBIGUOUS_TABULAR")
    )
    return joined.select(tag.alias("tag"), "time_column", F.array_join("measures", ",").alias("measures"))


def _falls(times: DataFrame) -> DataFrame:
    """falls: how many rows are not later than the row before, by blocks of places.

    Rows are compared within blocks, and the blocks' ends with one another, so no
    task sorts the whole table.
    """
    from pyspark.sql import Window

    block = F.floor(F.col("at") / 100_000)
    rows = times.withColumn("block", block).withColumn("before", F.lag("t").over(Window.partitionBy("block").orderBy("at")))
    inside = rows.agg(F.count_if(F.col("t") <= F.col("before")).alias("inside"))
    ends = rows.groupBy("block").agg(F.min_by("t", "at").alias("first"), F.max_by("t", "at").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("block")))
    return inside.join(F.broadcast(ends.agg(F.count_if(F.col("first") <= F.col("before")).alias("between")))).select((F.col("inside") + F.col("between")).alias("falls"))


def admission(shapes: DataFrame, rows: DataFrame, least: int = 3) -> DataFrame:
    """status and workflow of a shaped table: go on, or ask for more."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    workflows = F.create_map(*[F.lit(x) for x in ("CROSS_SECTIONAL", "cross-sectional-investigation", "EVENT_TRANSACTION", "event-transaction-investigation", "TIME_SERIES", "generic-time-series-investigation")])
    goes = (F.col("tag") != "AMBIGUOUS_TABULAR") & (F.col("n") >= least)
    return shapes.join(F.broadcast(n)).select("tag", F.when(goes, "PROCEED").otherwise("NEEDS_INPUT").alias("status"), F.when(goes, workflows[F.col("tag")]).alias("workflow"))


def resolve_schema(headers: DataFrame, aliases: DataFrame, hints: DataFrame) -> DataFrame:
    """domain, score, eligible and status: which domain's vocabulary a table's headers are.

    ``headers``: name.  ``aliases``: domain, metric, alias, and whether the metric is
    strong, characteristic, an outcome or excluded.  ``hints``: domain, minimum_match,
    minimum_margin.  A score has 2 for each metric, 5 more if strong, 3 more if
    characteristic, 1 more for an outcome; the best eligible domain is ambiguous
    where the next best is closer than the margin.
    """
    keyed = aliases.withColumn("key", header_key(F.col("alias")))
    matched = headers.withColumn("key", header_key(F.col("name"))).join(keyed, "key")
    metrics = matched.groupBy("domain", "metric").agg(*[F.max(c).alias(c) for c in ("strong", "characteristic", "outcome", "excluded")])
    number = lambda c: F.count_if(F.col(c))
    scored = metrics.groupBy("domain").agg(F.count(F.lit(1)).alias("metrics"), number("strong").alias("strong"), number("characteristic").alias("characteristic"), number("outcome").alias("outcome"), number("excluded").alias("excluded")).join(hints, "domain")
    score = F.col("metrics") * 2 + F.col("strong") * 5 + F.col("characteristic") * 3 + F.col("outcome")
    eligible = (F.col("metrics") >= F.col("minimum_match")) & ((F.col("strong") >= 1) | (F.col("characteristic") >= 2)) & (F.col("excluded") == 0)
    scored = scored.withColumns({"score": score, "eligible": eligible})
    best = scored.filter("eligible").agg(F.min(F.struct((-F.col("score")).alias("less"), "domain", "score", "minimum_margin")).alias("best"))
    others = scored.join(F.broadcast(best)).filter(F.col("best.domain").isNull() | (F.col("domain") != F.col("best.domain"))).agg(F.max("score").alias("next"))
    status = F.when(F.col("best").isNull(), "UNKNOWN").when(F.col("best.score") - F.col("next") < F.col("best.minimum_margin"), "AMBIGUOUS").otherwise("RESOLVED")
    return scored.join(F.broadcast(best)).join(F.broadcast(others)).select("domain", "metrics", "score", "eligible", F.when(F.col("domain") == F.col("best.domain"), status).alias("status"))


def schema_names(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """name and renamed: the one metric of a header, unless two headers share it."""
    keyed = aliases.select(header_key(F.col("alias")).alias("key"), "metric").distinct()
    matched = headers.withColumn("key", header_key(F.col("name"))).join(keyed, "key", "left")
    shared = matched.filter("metric is not null").groupBy("metric").agg(F.count(F.lit(1)).alias("k"))
    return matched.join(shared, "metric", "left").select("name", F.when(F.col("k") == 1, F.col("metric")).otherwise(F.col("name")).alias("renamed"), F.when(F.col("k") == 1, "MATCHED").when(F.col("k") > 1, "AMBIGUOUS").otherwise("UNKNOWN").alias("status"))


def structure(long: DataFrame, concepts: DataFrame) -> DataFrame:
    """column, verdict and the checks that fail, of columns proposed for concepts.

    ``long``: name and cell.  ``concepts``: name, kind (NUMERIC, IDENTIFIER,
    CATEGORICAL, DATETIME) and unit (COUNT, DURATION, PERCENTAGE or another).
    """
    cell, x = F.col("cell"), numeric_cell(F.col("cell"))
    here = present(cell)
    whole = F.abs(x - F.round(x)) <= 1e-9
    facts = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(here).alias("n"),
        F.count(x).alias("numbers"),
        F.count_distinct(F.when(here, F.lower(F.trim(cell)))).alias("unique"),
        F.coalesce(F.bool_and(x >= 0), F.lit(True)).alias("positive"),
        F.coalesce(F.bool_and(whole), F.lit(True)).alias("whole"),
        F.count_if(~whole).alias("fractions"),
        F.max("x").alias("high") if "x" in long.columns else F.max(x).alias("high"),
        F.coalesce(F.bool_or((x > 0) & (x < 1)) & F.bool_or(x > 1), F.lit(False)).alias("mixed_scale"),
        F.count(period_time(cell)).alias("dates"),
    )
    f = facts.join(concepts, "name")
    n, numbers, unique = F.col("n"), F.col("numbers"), F.col("unique")
    numeric, named, dated, classed = (F.col("kind") == k for k in ("NUMERIC", "IDENTIFIER", "DATETIME", "CATEGORICAL"))
    unit = F.col("unit")
    # (check, failed, rejects)
    rules = [
        ("support", ~((n >= 3) & ((F.col("rows") - n) / F.col("rows") <= 0.05)), F.lit(False)),
        ("numeric_compatibility", numeric & (numbers / n < 0.95), numbers == 0),
        ("numeric_borderline", numeric & (numbers != n), F.lit(False)),
        ("count_unit", numeric & (unit == "COUNT") & (numbers > 0) & ~(F.col("positive") & F.col("whole")), F.lit(True)),
        ("duration_unit", numeric & (unit == "DURATION") & (numbers > 0) & ~F.col("positive"), F.lit(True)),
        ("percentage_range", numeric & (unit == "PERCENTAGE") & (numbers > 0) & ~(F.col("positive") & (F.col("high") <= 100)), F.lit(True)),
        ("percentage_scale", numeric & (unit == "PERCENTAGE") & F.col("mixed_scale"), F.lit(False)),
        ("identifier_uniqueness", named & (unique / n < 0.95), (n >= 3) & (unique / n < 0.5)),
        ("identifier_measure_distribution", named & (numbers == n) & (F.col("fractions") / numbers >= 0.8), F.lit(True)),
        ("datetime_parser", dated & (F.col("dates") != n), F.col("dates") == 0),
        ("categorical_variation", classed & (unique <= 1), F.lit(False)),
        ("categorical_cardinality", classed & ~((n >= 5) & (unique / n <= 0.8)), F.lit(False)),
    ]
    failed = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test, _ in rules]))
    rejected = F.lit(False)
    for _, test, hard in rules:
        rejected = rejected | (F.coalesce(test, F.lit(False)) & hard)
    return f.select("name", F.when(rejected, "REJECTED").when(F.size(failed) > 0, "AMBIGUOUS").otherwise("STRUCTURALLY_CONFIRMED").alias("verdict"), F.array_join(failed, ",").alias("failed"))
