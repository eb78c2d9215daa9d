"""Controlled exports: which rows a validated result may export, and whether it may.

A proposal is bound to its rows by their number and an ordered digest, never by a list
of all ids, so it stays one short row however many rows are exported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.canonical import ordered_digest_of
from larkspur.functions.columns import claims_cause, url_component
from larkspur.functions.rownumbers import numbered

#: Workflows that may export, and the targets of each.
TARGETS = {
    "cross-sectional-investigation": ["highlighted_entities"],
    "event-transaction-investigation": ["notable_events", "priority_interventions"],
    "generic-time-series-investigation": ["leading_signals"],
}
ACTION = "EXPORT_DECISION"
SERIES = "generic-time-series-investigation"

#: Why a proposal is refused, in the order in which rules are tried.
REFUSALS = {
    "SCHEMA_INVALID": "The action proposal does not have the required shape.",
    "VALIDATION_NOT_PASSED": "The investigation artifact is not VALIDATED.",
    "ACTION_TYPE_NOT_ALLOWED": "The action type is not allowed.",
    "WORKFLOW_NOT_ELIGIBLE": "The workflow is not eligible for controlled actions.",
    "INVALID_TARGET": "The target is not allowed for the workflow.",
    "INVALID_EVIDENCE_REFERENCE": "One or more cited Evidence references do not exist in the validated artifact.",
    "WORKFLOW_MISMATCH": "The proposal must match the validated artifact's workflow.",
    "ARTIFACT_HASH_MISMATCH": "The actual artifact and proposal must match the validated hash.",
    "INVALID_TARGET_ID": "Target IDs must exactly match eligible artifact rows in order.",
    "CAUSAL_OVERCLAIM_IN_REASON": "The action reason asserts a causal claim the investigation never established.",
    "DUPLICATE_EXECUTION": "This exact action has already been executed for this validated artifact.",
}


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def policy(proposals: DataFrame, evidence: DataFrame, key: str = "subject") -> DataFrame:
    """key, allowed, status, reason_code and reason of each proposal.

    ``proposals`` have type, workflow_id, target, reason, evidence_refs, validated_hash,
    target_digest and what is known of their result: validation_status,
    artifact_workflow, expected_workflow, artifact_target, artifact_validated_hash,
    artifact_hash, artifact_target_digest, executed.  ``evidence`` has key and
    evidence_id, all that the validated result holds.

    Rules are tried in the order of ``REFUSALS``; the first that fails decides.  Cited
    evidence is looked up by a join; all other rules are decided within the row.
    """
    cited = proposals.select(key, F.explode("evidence_refs").alias("evidence_id")).distinct()
    unknown = cited.join(evidence.select(key, "evidence_id"), [key, "evidence_id"], "left_anti").groupBy(key).agg(F.lit(True).alias("_unknown"))
    allowed = F.create_map(*[x for w, targets in TARGETS.items() for x in (F.lit(w), F.array(*[F.lit(t) for t in targets]))])
    of_workflow = F.try_element_at(allowed, F.coalesce("workflow_id", F.lit("")))
    foreign = _differs(F.col("artifact_workflow"), F.col("expected_workflow")) | _differs(F.col("workflow_id"), F.col("artifact_workflow"))
    unbound = _missing(F.col("artifact_validated_hash")) | _differs(F.col("artifact_hash"), F.col("artifact_validated_hash")) | _differs(F.col("validated_hash"), F.col("artifact_validated_hash"))
    # Only series have a single target, so for them this adds nothing.
    elsewhere = (F.col("workflow_id") != SERIES) & _differs(F.col("target"), F.col("artifact_target"))
    failures = [
        ("SCHEMA_INVALID", _missing(F.col("target")) | _missing(F.col("reason")) | F.col("evidence_refs").isNull()),
        ("VALIDATION_NOT_PASSED", _differs(F.col("validation_status"), F.lit("VALIDATED"))),
        ("ACTION_TYPE_NOT_ALLOWED", _differs(F.col("type"), F.lit(ACTION))),
        ("WORKFLOW_NOT_ELIGIBLE", of_workflow.isNull()),
        ("INVALID_TARGET", ~F.coalesce(F.array_contains(of_workflow, F.col("target")), F.lit(False))),
        ("INVALID_EVIDENCE_REFERENCE", F.coalesce("_unknown", F.lit(False))),
        ("WORKFLOW_MISMATCH", foreign),
        ("ARTIFACT_HASH_MISMATCH", unbound),
        ("INVALID_TARGET", elsewhere),
        ("INVALID_TARGET_ID", F.col("target_digest").isNull() | _differs(F.col("target_digest"), F.col("artifact_target_digest"))),
        ("CAUSAL_OVERCLAIM_IN_REASON", claims_cause(F.col("reason"))),
        ("DUPLICATE_EXECUTION", F.coalesce("executed", F.lit(False))),
    ]
    first = F.coalesce(*[F.when(failed, code) for code, failed in failures], F.lit("OK"))
    decided = proposals.join(unknown, key, "left").select(key, first.alias("reason_code"))
    why = F.create_map(*[F.lit(x) for item in ({"OK": "All deterministic policy checks passed."} | REFUSALS).items() for x in item])
    fine = F.col("reason_code") == "OK"
    return decided.select(key, fine.alias("allowed"), F.when(fine, "POLICY_APPROVED").otherwise("REJECTED").alias("status"), "reason_code", why[F.col("reason_code")].alias("reason"))


def event_targets(notable: DataFrame) -> DataFrame:
    """position, id, reasons, evidence_refs of notable events, in the order of their rows."""
    return notable.select(F.col("source_row").alias("position"), F.col("event_id").alias("id"), "reasons", F.array(F.lit("E-006")).alias("evidence_refs"))


def entity_targets(entities: DataFrame) -> DataFrame:
    """The same of high-risk entities (position, entity_id, reasons), by their rank."""
    return entities.select("position", F.col("entity_id").alias("id"), "reasons", F.array(F.lit("E-005")).alias("evidence_refs"))


def signal_targets(edges: DataFrame) -> DataFrame:
    """The same of leading signals (position, source, target, lag and statistics)."""
    name = F.concat_ws("::", url_component(F.col("source")), url_component(F.col("target")), F.col("lag").cast("string"))
    why = F.array(F.lit("Observed precursor relationship; causality is not established."))
    return edges.select("*", name.alias("id"), why.alias("reasons"), F.array().cast("array<string>").alias("evidence_refs"))


def propose(rows: DataFrame, workflow: str, validated_hash: str) -> DataFrame:
    """The one proposal for target rows: what, why, with which evidence, bound to which rows.

    Places of rows are any rising numbers; the digest counts ids in that order, so it is
    taken over numbers from 1 on (column ``position`` of ``numbered_targets``).
    """
    n = F.count(F.lit(1))
    reasons = {
        "cross-sectional-investigation": F.concat(F.lit("Export the "), n.cast("string"), F.when(n == 1, " entity").otherwise(" entities"), F.lit(" that meet the validated high-risk selection rule, with their supporting Evidence references.")),
        "event-transaction-investigation": F.concat(F.lit("Export the "), n.cast("string"), F.lit(" source "), F.when(n == 1, "event").otherwise("events"), F.lit(" that matched at least one validated deterministic attention rule, with their supporting Evidence references.")),
        SERIES: F.lit("Export observed leading-signal relationships for operator follow-up; causality is not established."),
    }
    head = rows.agg(n.alias("n"), reasons[workflow].alias("reason"), ordered_digest_of(F.col("position"), F.col("id")).alias("target_digest"))
    cited = rows.select("position", F.explode("evidence_refs").alias("ref")).groupBy("ref").agg(F.min("position").alias("at"))
    refs = cited.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("evidence_refs"))
    return head.crossJoin(F.broadcast(refs)).select(F.lit(ACTION).alias("type"), F.lit(workflow).alias("workflow_id"), F.lit(TARGETS[workflow][0]).alias("target"), "reason", "evidence_refs", F.lit(validated_hash).alias("validated_hash"), "target_digest", "n")


def numbered_targets(rows: DataFrame) -> DataFrame:
    """Target rows with places 1, 2, 3, ... in the order of their positions."""
    dealt = rows.withColumnRenamed("position", "_rank").repartitionByRange("_rank", "id").sortWithinPartitions("_rank", "id")
    return numbered(dealt, "position", first=1).drop("_rank")
