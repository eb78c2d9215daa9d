"""Product names to SKUs: exact, by words, then by spelling.

A name that leads to several SKUs is *blocked*: found, without a SKU.  A blocked
name never falls through to the next step.  Spelling is compared by an exact
set-similarity join: a candidate is cut into more segments than edits are
allowed, so one segment must occur unchanged near its place in the other name.
All steps are equi-joins; no pairs of a whole group are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length, words, similarity, and lead over the next SKU.
LEAST_CHARS, LEAST_WORDS, LEAST_SIMILARITY, LEAST_LEAD = 20, 3, 0.94, 0.03
#: A rival below this can't come within the lead of an accepted name.
RIVAL = LEAST_SIMILARITY - LEAST_LEAD
_SLACK = 1e-9


def normalized(name: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def comparable(name: Column) -> Column:
    """Letters and digits of the normalized name, other runs as one space."""
    return F.trim(F.regexp_replace(F.translate(normalized(name), "ё", "е"), "[^a-zа-я0-9]+", " "))


def word_signature(name: Column) -> Column:
    return F.array_join(F.sort_array(F.split(comparable(name), " ")), " ")


def number_signature(name: Column) -> Column:
    found = F.regexp_extract_all(normalized(name), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.array_join(F.sort_array(F.transform(found, lambda x: F.translate(x, ",", "."))), "|")


def _one_sku(known: DataFrame, key: str, out: str) -> DataFrame:
    """key, and its only SKU or null if it has several."""
    return known.groupBy(key).agg(F.when(F.min("sku") == F.max("sku"), F.min("sku")).alias(out))


def _known(identities: DataFrame) -> DataFrame:
    name = F.col("product_name")
    rows = identities.select("sku", normalized(name).alias("norm"), comparable(name).alias("plain"), word_signature(name).alias("words"), number_signature(name).alias("numbers"))
    return rows.filter("norm <> '' and plain <> '' and sku is not null")


def exact(names: DataFrame, identities: DataFrame) -> DataFrame:
    """norm, sku for each distinct normalized name of ``names`` that is known."""
    index = _one_sku(_known(identities), "norm", "sku")
    return names.select(normalized(F.col("product_name")).alias("norm")).distinct().join(index, "norm")


def by_words(names: DataFrame, identities: DataFrame) -> DataFrame:
    """norm, sku by the same set of words in any order."""
    index = _one_sku(_known(identities), "words", "sku")
    probes = names.select(normalized(F.col("product_name")).alias("norm"), word_signature(F.col("product_name")).alias("words")).filter("words <> ''").distinct()
    return probes.join(index, "words").select("norm", "sku")


def _edits(length: Column) -> Column:
    """Edits that a name of this length allows at the rival's similarity."""
    return F.floor(length * ((1 - RIVAL) / RIVAL) + _SLACK).cast("int")


def _segment(length: Column, count: Column, i: Column) -> Column:
    """Start of segment i of ``count`` even ones."""
    return F.floor(i * length / count).cast("int")


def by_spelling(names: DataFrame, identities: DataFrame) -> DataFrame:
    """norm, sku for names close enough to one SKU; null sku where two SKUs are as close."""
    name = F.col("product_name")
    probes = names.select(normalized(name).alias("norm"), comparable(name).alias("left"), number_signature(name).alias("numbers")).distinct()
    probes = probes.filter((F.length("left") >= LEAST_CHARS) & (F.size(F.split("left", " ")) >= LEAST_WORDS))
    # Two SKUs of a spelling are as good as all of them: either one is the rival.
    known = _known(identities).groupBy("plain", "numbers").agg(F.min("sku").alias("low"), F.max("sku").alias("high"))

    count = F.col("edits") + 1
    cut = known.withColumns({"size": F.length("plain"), "edits": _edits(F.length("plain"))}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start, stop = _segment(F.col("size"), count, F.col("i")), _segment(F.col("size"), count, F.col("i") + 1)
    segments = cut.select("numbers", "size", "i", "plain", "low", "high", F.substring(F.col("plain"), start + 1, stop - start).alias("part"))

    length = F.length("left")
    sizes = F.sequence(F.ceil(length * RIVAL - _SLACK).cast("int"), F.floor(length / RIVAL + _SLACK).cast("int"))
    places = probes.withColumn("size", F.explode(sizes)).withColumn("edits", _edits(F.col("size"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    places = places.withColumns({"start": start, "wide": stop - start})
    first, last = F.greatest(F.lit(0), F.col("start") - F.col("edits")), F.least(length - F.col("wide"), F.col("start") + F.col("edits"))
    windows = places.filter(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    windows = windows.select("norm", "left", "numbers", "size", "i", F.substring(F.col("left"), F.col("at") + 1, F.col("wide")).alias("part"))

    met = windows.join(segments, ["numbers", "size", "i", "part"]).select("norm", "left", "plain", "low", "high").distinct()
    likeness = 1 - F.levenshtein("left", "plain") / F.greatest(F.length("left"), F.length("plain"))
    scored = met.withColumn("score", likeness).filter(F.col("score") > RIVAL - _SLACK)
    skus = F.array_distinct(F.array("low", "high"))
    by_sku = scored.select("norm", "score", F.explode(skus).alias("sku")).groupBy("norm", "sku").agg(F.max("score").alias("score"))
    # The best two scores of distinct SKUs, each a bounded state.
    best = by_sku.groupBy("norm").agg(F.max(F.struct("score", "sku")).alias("best"))
    rival = by_sku.join(best, "norm").filter(F.col("sku") != F.col("best.sku")).groupBy("norm").agg(F.max("score").alias("rival"))
    final = best.join(rival, "norm", "left").filter(F.col("best.score") >= LEAST_SIMILARITY)
    lead = F.col("best.score") - F.coalesce("rival", F.lit(0.0))
    return final.select("norm", F.when(lead >= LEAST_LEAD, F.col("best.sku")).alias("sku"))


def resolve(names: DataFrame, identities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """norm, found, sku for every distinct normalized name of ``names``."""
    wanted = names.select(normalized(F.col("product_name")).alias("norm")).filter("norm is not null").distinct()
    out = wanted.withColumns({"found": F.lit(False), "sku": F.lit(None).cast("string")})
    for step in (exact, by_words, by_spelling)[: 3 if fuzzy else 2]:
        hit = step(names, identities).select("norm", F.struct("sku").alias("hit"))
        if step is not exact:
            # Spellings of one normalized name share their signatures.
            hit = hit.dropDuplicates(["norm"])
        fresh = ~F.col("found") & F.col("hit").isNotNull()
        out = out.join(hit, "norm", "left").select("norm", (F.col("found") | F.col("hit").isNotNull()).alias("found"), F.when(fresh, F.col("hit.sku")).otherwise(F.col("sku")).alias("sku"))
    return out


def reconcile(rows: DataFrame, authoritative: DataFrame) -> DataFrame:
    """``rows`` (sku, product_name, ...) with ``resolved``: the SKU to book them under, or null.

    A row with a SKU takes an authoritative one of its exact name or words, else
    keeps its own.  A row without one goes through all steps against the
    authoritative names, then against the rows that have a SKU.
    """
    keyed = rows.withColumn("_norm", normalized(F.col("product_name")))
    coded, bare = keyed.filter("coalesce(sku, '') <> ''"), keyed.filter("coalesce(sku, '') = ''")
    own = resolve(coded, authoritative, fuzzy=False).select(F.col("norm").alias("_norm"), F.col("sku").alias("_sku"))
    first = resolve(bare, authoritative)
    second = resolve(bare, coded.select("sku", "product_name")).select("norm", F.col("sku").alias("_second"))
    either = first.join(second, "norm").select(F.col("norm").alias("_norm"), F.when(F.col("found"), F.col("sku")).otherwise(F.col("_second")).alias("_sku"))
    done = coded.join(own, "_norm", "left").withColumn("resolved", F.coalesce("_sku", "sku"))
    return done.unionByName(bare.join(either, "_norm", "left").withColumn("resolved", F.col("_sku"))).drop("_norm", "_sku")


def unmatched(reconciled: DataFrame, order: str) -> DataFrame:
    """norm and its first spelling, for names that found no SKU."""
    name = F.trim(F.regexp_replace("product_name", r"(?U)\s+", " "))
    left = reconciled.filter("resolved is null").withColumn("norm", normalized(F.col("product_name"))).filter("norm <> ''")
    return left.groupBy("norm").agg(F.min_by(name, F.col(order)).alias("product_name"))
