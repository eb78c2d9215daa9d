"""Names of columns against a vocabulary: domains of many tables at once, concepts of
single names, and short lists of concepts for names that nothing resolves.

All matching is by equi-joins on normalised names, on their prefixes of whole words, or
on words, so work grows with the names and not with names times concepts.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Single characters and their compatibility forms, by the rule of Unicode.
_FORMS = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
_FORMS = [(a, b) for a, b in _FORMS if a != b and len(b) == 1]
_FROM, _TO = "".join(a for a, _ in _FORMS), "".join(b for _, b in _FORMS)

#: Names too vague to resolve, words too weak to count, words of units.
VAGUE = ("срок", "score", "id", "сумма", "дата", "тип", "значение")
WEAK = (*VAGUE, "amount", "status", "статус", "value")
UNIT_WORDS = {
    "DAYS": ("days", "дни", "дней", "сутки", "суток"),
    "HOURS": ("hours", "часов", "часы"),
    "CURRENCY": ("currency", "тенге", "руб", "рублей", "kzt", "usd", "rub"),
    "PERCENTAGE": ("percent", "процент", "процентов"),
    "COUNT": ("count", "количество", "число"),
}
LEAST_PREFIX, MOST_CANDIDATES, SHORTEST_WORD, UNIT_SCORE = 6, 15, 3, 3
STAGES = ("EXACT_CANONICAL", "EXACT_ALIAS", "NORMALIZED_ALIAS", "PREFIX_ALIAS")


def _plain(c: Column) -> Column:
    """Single-character compatibility forms, lower case, one letter for yo."""
    return F.replace(F.lower(F.translate(c, _FROM, _TO)), F.lit("ё"), F.lit("е"))


def metric_key(c: Column) -> Column:
    """A name of a metric: words of mixed case apart, dashes and punctuation as spaces."""
    apart = F.regexp_replace(F.translate(c, _FROM, _TO), r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(_plain(apart), "[\\p{Pd}_/(),.;:«»\"'!?\\s]+", " ")
    return F.trim(spaced)


def concept_key(c: Column) -> Column:
    """A name of a column: dashes and punctuation as spaces."""
    return F.trim(F.regexp_replace(_plain(c), "[\\p{Pd}−_(),.%/;:«»\"№'\\s]+", " "))


def resolve_schemas(headers: DataFrame, aliases: DataFrame, hints: DataFrame, by: list[str]) -> DataFrame:
    """by, domain, metrics, score, eligible and status, for all tables of ``headers`` at once.

    ``headers`` have the keys ``by`` of a table and name, a row a column.  A score has 2 for
    each metric, 5 more if strong, 3 more if characteristic, 1 more for an outcome.  The
    best eligible domain, by name among equals, is ambiguous where the next best of the
    table is closer than the margin.
    """
    keyed = aliases.withColumn("key", metric_key(F.col("alias"))).drop("alias").distinct()
    matched = headers.withColumn("key", metric_key(F.col("name"))).join(keyed, "key")
    metrics = matched.groupBy(*by, "domain", "metric").agg(*[F.max(c).alias(c) for c in ("strong", "characteristic", "outcome", "excluded")])
    number = lambda c: F.count_if(F.col(c))
    scored = metrics.groupBy(*by, "domain").agg(F.count(F.lit(1)).alias("metrics"), number("strong").alias("strong"), number("characteristic").alias("characteristic"), number("outcome").alias("outcome"), number("excluded").alias("excluded")).join(hints, "domain")
    score = F.col("metrics") * 2 + F.col("strong") * 5 + F.col("characteristic") * 3 + F.col("outcome")
    eligible = (F.col("metrics") >= F.col("minimum_match")) & ((F.col("strong") >= 1) | (F.col("characteristic") >= 2)) & (F.col("excluded") == 0)
    # A table has as many rows here as there are domains.
    table = Window.partitionBy(*by)
    best = F.min(F.when(F.col("eligible"), F.struct((-F.col("score")).alias("less"), "domain"))).over(table)
    rows = scored.withColumns({"score": score, "eligible": eligible}).withColumn("best", best).withColumn("first", F.col("domain").eqNullSafe(F.col("best.domain")))
    rows = rows.withColumn("next", F.max(F.when(~F.col("first"), F.col("score"))).over(table))
    close = F.coalesce(F.col("score") - F.col("next") < F.col("minimum_margin"), F.lit(False))
    status = F.when(F.col("first"), F.when(close, "AMBIGUOUS").otherwise("RESOLVED"))
    return rows.select(*by, "domain", "metrics", "score", "eligible", status.alias("status"))


def resolve_columns(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """name, normalized, method, concept and candidates of each distinct name.

    ``concepts`` have concept, aliases and exact_only.  Names are tried whole against
    concepts, then aliases, then normalised, then by prefixes of whole words, which are
    joined one by one.  The first stage with a match decides, in it the longest alias; several
    concepts with one of that length make the name ambiguous.
    """
    asked = names.select("name").distinct().withColumn("normalized", concept_key(F.col("name")))
    open_ = asked.filter((F.col("normalized") != "") & ~F.col("normalized").isin(*VAGUE))
    named = concepts.select("concept", "exact_only", F.explode("aliases").alias("alias")).withColumn("key", concept_key(F.col("alias"))).filter("key <> ''")
    free = named.filter("not exact_only").select("key", "concept").distinct()
    length = F.char_length("key").alias("length")
    found = open_.join(concepts.select(F.col("concept").alias("name"), "concept").distinct(), "name").select("name", F.lit(0).alias("stage"), "concept", F.char_length("name").alias("length"))
    found = found.unionByName(open_.join(named.select(F.col("alias").alias("name"), "key", "concept"), "name").select("name", F.lit(1).alias("stage"), "concept", length))
    found = found.unionByName(open_.withColumn("key", F.col("normalized")).join(free, "key").select("name", F.lit(2).alias("stage"), "concept", length))
    words = F.split("normalized", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    begun = open_.filter(F.size(words) > 1).select("name", F.explode(prefixes).alias("key")).filter(F.char_length("key") >= LEAST_PREFIX)
    found = found.unionByName(begun.join(free, "key").select("name", F.lit(3).alias("stage"), "concept", length))
    # One aggregate: by stage and length, the concepts that match; then the best of these.
    best = found.groupBy("name", "stage", "length").agg(F.array_sort(F.collect_set("concept")).alias("candidates")).groupBy("name").agg(F.min(F.struct("stage", (-F.col("length")).alias("shorter"), "candidates")).alias("b"))
    one = F.size("b.candidates") == 1
    method = F.when(F.col("b").isNull(), "UNRESOLVED").when(~one, "AMBIGUOUS").otherwise(F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("b.stage") + 1))
    return asked.join(best, "name", "left").select("name", "normalized", method.alias("method"), F.when(one, F.get("b.candidates", F.lit(0))).alias("concept"), F.coalesce("b.candidates", F.array().cast("array<string>")).alias("candidates"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_plain(c), F.lit(r"([\p{L}\p{N}]+)")))


def shortlist(columns: DataFrame, concepts: DataFrame, by: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """by, concept, score and rank of the concepts that a column's words point to.

    ``columns`` have the keys ``by``, name, context (texts around it: the objective and
    neighbouring names) and facts of all cells: n, n_rows, unique, numbers, dates, positive,
    whole, high, kind.  ``concepts`` have concept, texts, aliases, data_type, family,
    exact_only.  Words meet in an inverted index; a score is the number of shared words,
    three more for a word of the concept's unit and one more if the name is ambiguous.
    Concepts that the cells contradict are left out.  Equal scores stay together: a group
    that does not fit into ``most`` places is left out with all below it.
    """
    resolved = resolve_columns(columns, concepts).filter("method in ('UNRESOLVED', 'AMBIGUOUS')").select("name", "method", "candidates")
    strong = lambda ws: F.filter(ws, lambda w: (F.char_length(w) >= SHORTEST_WORD) & ~w.isin(*WEAK))
    open_ = columns.filter("n > 0").join(resolved, "name").withColumn("words", strong(_words(F.concat_ws(" ", "name", "context"))))
    said = concepts.select("concept", F.explode(_words(F.array_join("texts", " "))).alias("word"), F.lit(1).alias("shared"), F.lit(0).alias("unit"))
    units = F.create_map(*[x for k, ws in UNIT_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    measured = concepts.filter(F.col("family").isin(*UNIT_WORDS)).select("concept", F.explode(F.element_at(units, F.col("family"))).alias("word"), F.lit(0).alias("shared"), F.lit(1).alias("unit"))
    hits = open_.select(*by, F.explode("words").alias("word")).join(said.unionByName(measured), "word").select(*by, "concept", "shared", "unit")
    hits = hits.unionByName(open_.filter("method = 'AMBIGUOUS'").select(*by, F.explode("candidates").alias("concept"), F.lit(0).alias("shared"), F.lit(0).alias("unit")))
    pairs = hits.groupBy(*by, "concept").agg(F.sum("shared").alias("shared"), F.max("unit").alias("unit"))
    facts = open_.join(pairs, by).join(concepts.select("concept", "data_type", "family").distinct(), "concept")
    numeric, n = F.col("data_type") == "NUMERIC", F.col("n")
    fits = F.when(numeric, F.col("numbers") > 0).when(F.col("data_type") == "DATETIME", F.col("dates") == n)
    fits = fits.when(F.col("data_type") == "IDENTIFIER", (F.col("unique") / F.col("n_rows") >= 0.9) & ((F.col("n_rows") - n) / F.col("n_rows") <= 0.05))
    fits = fits.when(F.col("data_type").isin("CATEGORICAL", "TEXT"), (F.col("kind") != "numeric") & (F.col("dates") < n)).otherwise(True)
    broken = numeric & F.when(F.col("family") == "COUNT", ~(F.col("positive") & F.col("whole"))).when(F.col("family").isin("DAYS", "HOURS", "DURATION"), ~F.col("positive")).when(F.col("family") == "PERCENTAGE", ~(F.col("positive") & (F.col("high") <= 100))).otherwise(False)
    named = (F.col("method") == "UNRESOLVED") | F.array_contains("candidates", F.col("concept"))
    kept = facts.filter(fits & ~F.coalesce(broken, F.lit(False)) & named)
    score = F.col("shared") + F.col("unit") * UNIT_SCORE + F.when(F.col("method") == "AMBIGUOUS", 1).otherwise(0)
    scored = kept.select(*by, "concept", score.alias("score")).filter("score > 0")
    column = Window.partitionBy(*by)
    upto = scored.withColumn("upto", F.count(F.lit(1)).over(column.orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)))
    return upto.filter(F.col("upto") <= most).withColumn("rank", F.row_number().over(column.orderBy(F.desc("score"), "concept")).cast("long")).select(*by, "concept", "score", "rank")
