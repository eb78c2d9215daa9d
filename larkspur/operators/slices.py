"""Whether an artifact is what its data gives: slices by digest, rows only where they differ.

An artifact is a set of named relations.  Each row becomes its canonical JSON, each slice
of a relation a count and a sum of row hashes, which any partitioning and order leaves
alone.  Slices are compared first; rows are compared only in slices that differ, and
there only in the buckets of rows that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.canonical import digest_of, row_json
from larkspur.functions.checkpoints import kept
from larkspur.operators import events as E
from larkspur.operators.cross_section import Section

BUCKETS = 256


def artifact(parts: dict[str, DataFrame]) -> DataFrame:
    """slice, row: the rows of all relations as canonical JSON."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("slice"), row_json(df).alias("row")) for name, df in parts.items()])


def _bucket() -> Column:
    return F.pmod(F.crc32("row"), F.lit(BUCKETS)).cast("int")


def digests(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("slice", *by).agg(digest_of(F.col("row")).alias("digest"), F.count(F.lit(1)).alias("n"))


def compare(claimed: DataFrame, recomputed: DataFrame, *by: str) -> DataFrame:
    """slice, passed and the number of rows on either side; a slice of one side fails."""
    keys = ["slice", *by]
    a = digests(claimed, *by).select(*keys, F.col("digest").alias("_a"), F.col("n").alias("claimed"))
    b = digests(recomputed, *by).select(*keys, F.col("digest").alias("_b"), F.col("n").alias("recomputed"))
    return a.join(b, keys, "full").select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("passed"), F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("recomputed", F.lit(0)).alias("recomputed"))


def differences(claimed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """slice, row, claimed, recomputed: how often a row stands on each side, where that differs."""
    a, b = claimed.withColumn("_bucket", _bucket()), recomputed.withColumn("_bucket", _bucket())
    wrong = kept(compare(a, b, "_bucket").filter("not passed").select("slice", "_bucket"))
    of = lambda rows, mine: rows.join(wrong, ["slice", "_bucket"], "left_semi").select("slice", "row", F.lit(mine).alias("_mine"))
    counted = of(a, True).unionByName(of(b, False)).groupBy("slice", "row").agg(F.count_if("_mine").alias("claimed"), F.count_if(~F.col("_mine")).alias("recomputed"))
    return counted.filter("claimed <> recomputed")


def event_artifact(log: DataFrame) -> dict[str, DataFrame]:
    """The relations of an event investigation, by the check that recomputes each."""
    return {
        "EVENT_COUNT": log.agg(F.count(F.lit(1)).alias("events")),
        "EVENT_IDENTITY": E.profile(log),
        "EVENT_TYPE_COUNTS": E.type_counts(log).select("event_type", "n", "total"),
        "ENTITY_ACTIVITY": E.entity_activity(log),
        "TIMING_AND_BURSTS": E.groups(log, ["entity_id"], 3),
        "NOTABLE_EVENT_SELECTION": E.notable(log).select("event_id", "entity_id", "event_type", "value", "source_row", "reasons"),
        "CLUSTER_MEMBERSHIP": E.sessions(log, ["entity_id"], 2).select("entity_id", "run", "event_id", "source_row"),
    }


def section_artifact(section: Section, row: str) -> dict[str, DataFrame]:
    """The relations of a cross-section.  Floating sums differ in their last digits from one
    partitioning to the next, so they are held to nine decimals."""
    spark, t, groups = section.df.sparkSession, section.target, section.groups()
    exact = lambda df, *names: df.withColumns({c: F.round(c, 9) for c in names})
    related = section.associations(groups)
    return {
        "ENTITY_COUNT": section.df.agg(F.count(F.lit(1)).alias("entities")),
        "TARGET_RESOLUTION": spark.createDataFrame([(t.column, t.source, t.kind, t.authoritative, section.entity)], "column string, source string, kind string, authoritative boolean, entity string"),
        "NUMERIC_SUMMARIES": exact(section.numeric_summaries(), "mean", "deviation"),
        "CATEGORY_COUNTS": section.category_counts(),
        "ASSOCIATIONS": exact(related, "value", "strength"),
        "ASSOCIATION_GROUPS": exact(groups, "mean"),
        "DRIVERS": exact(section.drivers(related), "strength"),
        "HIGH_RISK_SELECTION": section.high_risk(row),
        "DERIVED_PREVALENCE": section.prevalence(),
    }


def validate(claimed: DataFrame, recomputed: DataFrame, references: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """check, passed, claimed, recomputed: a line for each slice, and one for references.

    ``references`` (evidence_id) are all that the artifact cites, ``evidence`` what it holds:
    every reference must resolve, and no id may stand for two records.
    """
    checks = compare(claimed, recomputed).withColumnRenamed("slice", "check")
    if references is None:
        return checks
    cited = references.select("evidence_id").distinct()
    lost = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    twice = evidence.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("twice"))
    n = cited.agg(F.count(F.lit(1)).alias("claimed"))
    line = lost.crossJoin(twice).crossJoin(n).select(F.lit("EVIDENCE_REFERENCES").alias("check"), ((F.col("lost") == 0) & (F.col("twice") == 0)).alias("passed"), "claimed", (F.col("claimed") - F.col("lost")).alias("recomputed"))
    return checks.unionByName(line)


def reproducible(records: DataFrame, tools: dict[str, tuple[bool, DataFrame]]) -> DataFrame:
    """``records`` (evidence_id, tool, requested_id, payload) with ``reproducible``.

    ``tools`` gives, for each tool, whether it takes an id, and its results (requested_id,
    payload) computed anew, one for each valid id or a single one without id.  A record is
    reproducible if its tool is known, its id is there exactly if the tool takes one, is
    valid, and the payload is the same.  All records are settled by one join.
    """
    takes = F.create_map(*[x for name, (by_id, _) in tools.items() for x in (F.lit(name), F.lit(by_id))])
    results = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tool"), F.coalesce(F.col("requested_id").cast("string"), F.lit("")).alias("_id"), F.col("payload").alias("_expected")) for name, (_, df) in tools.items()])
    rows = records.withColumns({"_id": F.coalesce("requested_id", F.lit("")), "_by_id": F.try_element_at(takes, F.coalesce("tool", F.lit("")))})
    shaped = F.col("_by_id").isNotNull() & (F.col("_by_id") == F.col("requested_id").isNotNull())
    joined = rows.join(results, ["tool", "_id"], "left")
    return joined.withColumn("reproducible", F.coalesce(shaped & F.col("payload").eqNullSafe(F.col("_expected")) & F.col("_expected").isNotNull(), F.lit(False))).drop("_id", "_by_id", "_expected")


def event_tools(log: DataFrame) -> dict[str, tuple[bool, DataFrame]]:
    """Results of the tools that a reader of an event investigation may ask for."""
    types = E.type_counts(log).select("event_type", "n")
    activity = E.entity_activity(log)
    every = lambda df: df.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(row_json(df))), ","), F.lit("]")).alias("payload")).select(F.lit(None).cast("string").alias("requested_id"), "payload")
    return {
        "inspect_event_record": (True, log.select(F.col("event_id").alias("requested_id"), row_json(log, "event_id", "entity_id", "event_type", "value", "source_row").alias("payload"))),
        "inspect_entity_activity": (True, activity.select(F.col("entity_id").alias("requested_id"), row_json(activity).alias("payload"))),
        "summarize_event_types": (False, every(types)),
        "profile_event_transaction_dataset": (False, every(E.profile(log))),
    }
