"""Exports of validated decisions: proposed, checked, staged, verified, renamed, and entered in a ledger.

An export is named by its workflow, its result's hash and its action.  The ledger has one
entry a finished export, so a repeated one writes nothing; a run that was cut off leaves
either staged files, which the next run replaces, or finished files without an entry,
which it verifies and enters.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.canonical import number_text, ordered_digest_of, quoted
from larkspur.functions.checkpoints import kept
from larkspur.functions.rownumbers import numbered
from larkspur.operators import actions as A
from larkspur.sources.stores import Store, placed_lines, write_lines

#: The file of rows of each workflow, and its header.
ROWS_FILE = {"cross-sectional-investigation": "flagged_entities.csv", "event-transaction-investigation": "flagged_events.csv", A.SERIES: "leading_signals.csv"}
FLAGGED_HEADER = "id,reasons,evidence_refs"
SIGNALS_HEADER = "id,source_signal,target_signal,lag_periods,correlation,p_value,significant,paired_observations,ci95_lower,ci95_upper"
DECISION_FILE = "validated_decision.json"
CHECKS = ("ARTIFACTS_PRESENT", "TARGET_IDS_MATCH", "ROW_COUNT_MATCHES", "EVIDENCE_REFS_EXIST", "VALIDATION_STATUS_VALIDATED", "ARTIFACT_HASH_MATCHES", "JSON_REASON_MATCHES", "ARTIFACT_POLICY", "EXPORT_CONTRACT_MATCHES", "CSV_CONTENT_MATCHES")


@dataclass(frozen=True)
class Result:
    """A validated result: its target rows (numbered), evidence ids and hashes."""

    workflow: str
    rows: DataFrame
    evidence: DataFrame
    status: str
    validated_hash: str
    artifact_hash: str
    artifact_workflow: str | None = None

    @property
    def key(self) -> str:
        return hashlib.sha256(f"{self.workflow}:{self.validated_hash}:{A.ACTION}".encode()).hexdigest()


@dataclass
class Record:
    """What became of an export."""

    status: str
    key: str
    policy: str
    path: str | None = None
    checks: dict[str, bool] = field(default_factory=dict)
    rows: int | None = None


def _cell(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, workflow: str) -> DataFrame:
    """position and line of the file of rows; a cell with line feeds spans several lines."""
    if workflow == A.SERIES:
        header = SIGNALS_HEADER
        cells = ["id", "source", "target", F.col("lag").cast("string"), number_text(F.col("correlation")), number_text(F.col("p_value")), F.col("significant").cast("string"), F.col("n").cast("string"), number_text(F.col("ci_low")), number_text(F.col("ci_high"))]
    else:
        header, cells = FLAGGED_HEADER, ["id", F.array_join("reasons", "; "), F.array_join("evidence_refs", " ")]
    line = F.concat_ws(",", *[_cell(F.col(c) if isinstance(c, str) else c) for c in cells])
    body = rows.select(F.col("position").alias("_row"), F.posexplode(F.split(line, "\n")).alias("_part", "line"))
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("_row"), F.lit(0).alias("_part"), F.lit(header).alias("line"))
    dealt = head.unionByName(body).repartitionByRange("_row", "_part").sortWithinPartitions("_row", "_part")
    return numbered(dealt, "position").select("position", "line")


def decision_lines(result: Result, proposal: Row, action_id: str, generated_at: str) -> DataFrame:
    """position and line of the decision: ids stand one a line, so no task holds them all."""
    text = lambda v: json.dumps(v, ensure_ascii=False)
    above = [("actionId", action_id), ("type", proposal["type"]), ("workflowId", proposal["workflow_id"]), ("validationStatus", result.status), ("validatedArtifactHash", result.validated_hash), ("target", proposal["target"])]
    below = [("evidenceRefs", list(proposal["evidence_refs"])), ("reason", proposal["reason"]), ("generatedAt", generated_at)]
    head = ["{", *[f'  "{k}": {text(v)},' for k, v in above], '  "targetIds": [']
    tail = ["  ],", *[f'  "{k}": {text(v)}' + "," * (k != below[-1][0]) for k, v in below], "}"]
    n = proposal["n"]
    fixed = [(k, line) for k, line in enumerate(head)] + [(len(head) + n + k, line) for k, line in enumerate(tail)]
    ids = result.rows.select((F.col("position") + len(head) - 1).alias("position"), F.concat(F.lit("    "), quoted(F.col("id")), F.when(F.col("position") < n, ",").otherwise("")).alias("line"))
    return result.rows.sparkSession.createDataFrame(fixed, "position long, line string").unionByName(ids)


def _policy(result: Result, proposal: Row, expected: Row, executed: bool) -> Row:
    """The rules on a proposal, given the one that the rows themselves lead to."""
    spark = result.rows.sparkSession
    facts = {"subject": "one", **{k: proposal[k] for k in ("type", "workflow_id", "target", "reason", "validated_hash", "target_digest")}, "validation_status": result.status, "artifact_workflow": result.artifact_workflow or result.workflow, "expected_workflow": result.workflow, "artifact_target": A.TARGETS[result.workflow][0], "artifact_validated_hash": result.validated_hash, "artifact_hash": result.artifact_hash, "artifact_target_digest": expected["target_digest"]}
    schema = ", ".join(f"{k} string" for k in facts) + ", evidence_refs array<string>, executed boolean"
    proposals = spark.createDataFrame([(*facts.values(), proposal["evidence_refs"], executed)], schema)
    return A.policy(proposals, result.evidence.select(F.lit("one").alias("subject"), "evidence_id")).first()


def read_decision(spark: SparkSession, path: str) -> tuple[dict[str, object] | None, DataFrame]:
    """The fields of a decision but for its ids, or None if it can't be read; and its
    ids (position from 1 on, text)."""
    lines = placed_lines(spark, path)
    own = lines.filter(~F.col("line").startswith("    ")).orderBy("position").limit(64).collect()
    at = next((r.position for r in own if r.line.startswith('  "targetIds": [')), None)
    ids = lines.filter(F.col("line").startswith("    ")).select((F.col("position") - (at or 0)).alias("position"), F.regexp_replace("line", "^    |,$", "").alias("text"))
    try:
        fields = {m[1]: json.loads(m[2]) for r in own if (m := re.fullmatch(r'  "(\w+)": (.*?),?', r.line)) and m[1] != "targetIds"}
    except ValueError:
        fields = None
    return fields, ids


def _digest(rows: DataFrame | None, text: Column) -> tuple[int, str]:
    """The number of placed texts and their digest; -1 without a file."""
    if rows is None:
        return -1, ""
    found = rows.agg(ordered_digest_of(F.col("position"), text).alias("d")).first()["d"]
    return int(found.partition("-")[0]), found


def verify(result: Result, proposal: Row, folder: str) -> dict[str, bool]:
    """The ten checks of written files against the result, each from data computed anew."""
    spark, store = result.rows.sparkSession, Store(result.rows.sparkSession, folder)
    names = [f"{folder}/{DECISION_FILE}", f"{folder}/{ROWS_FILE[result.workflow]}"]
    decided, listed = (store.exists(p) for p in names)
    expected = A.propose(result.rows, result.workflow, result.validated_hash).first()
    fields, ids = read_decision(spark, names[0]) if decided else (None, None)
    fields = fields or {}
    n_ids, got_ids = _digest(ids, F.col("text"))
    n_lines, got_lines = _digest(placed_lines(spark, names[1]) if listed else None, F.col("line"))
    n_wanted, wanted_lines = _digest(csv_lines(result.rows, result.workflow), F.col("line"))
    cited = spark.createDataFrame([(x,) for x in proposal["evidence_refs"]], "evidence_id string")
    refs = list(expected["evidence_refs"])
    contract = (fields.get("workflowId"), fields.get("target"), fields.get("type"), fields.get("validationStatus")) == (result.workflow, A.TARGETS[result.workflow][0], A.ACTION, "VALIDATED")
    passed = (
        bool(fields) and n_lines > 0,
        got_ids == _digest(result.rows, quoted(F.col("id")))[1],
        n_ids == expected["n"] and n_lines == n_wanted,
        cited.join(result.evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").isEmpty(),
        result.status == "VALIDATED",
        fields.get("validatedArtifactHash") == result.validated_hash,
        fields.get("reason") == proposal["reason"],
        bool(_policy(result, proposal, expected, False)["allowed"]),
        contract and fields.get("evidenceRefs") == refs and list(proposal["evidence_refs"]) == refs,
        got_lines == wanted_lines,
    )
    return dict(zip(CHECKS, passed))


def export(result: Result, root: str, generated_at: str, action_id: str = "A-001", proposal: Row | None = None) -> Record:
    """Propose, check, stage, verify, rename, enter.  A finished export is refused."""
    spark, store, key = result.rows.sparkSession, Store(result.rows.sparkSession, root), result.key
    entry, staged, final = f"{root}/_ledger/{key}.json", f"{root}/_staged/{key}", f"{root}/{key}"
    expected = A.propose(result.rows, result.workflow, result.validated_hash).first()
    proposal = proposal or expected
    allowed = _policy(result, proposal, expected, store.exists(entry))
    if not allowed["allowed"]:
        return Record("REJECTED", key, allowed["reason_code"])
    checks = verify(result, proposal, final) if store.exists(final) else {}
    if not (checks and all(checks.values())):
        store.delete(final)
        store.delete(staged)
        write_lines(decision_lines(result, proposal, action_id, generated_at), f"{staged}/{DECISION_FILE}")
        write_lines(csv_lines(result.rows, result.workflow), f"{staged}/{ROWS_FILE[result.workflow]}")
        checks = verify(result, proposal, staged)
        if not all(checks.values()):
            return Record("FAILED", key, "OK", None, checks, proposal["n"])
        store.rename(staged, final)
    store.write(entry, json.dumps({"action": action_id, "key": key, "rows": proposal["n"], "validatedArtifactHash": result.validated_hash, "workflow": result.workflow}, sort_keys=True))
    return Record("VERIFIED", key, "OK", final, checks, proposal["n"])


def exported(result: Result, root: str, generated_at: str, action_id: str = "A-001") -> Record:
    """The export of a result, made once: a later call verifies the files again and writes
    nothing.  A result that is not what was validated is refused whatever was exported."""
    store, key = Store(result.rows.sparkSession, root), result.key
    bound = result.status == "VALIDATED" and result.artifact_hash == result.validated_hash and (result.artifact_workflow or result.workflow) == result.workflow
    if not bound or not store.exists(f"{root}/_ledger/{key}.json"):
        return export(result, root, generated_at, action_id)
    proposal = A.propose(result.rows, result.workflow, result.validated_hash).first()
    checks = verify(result, proposal, f"{root}/{key}")
    return Record("VERIFIED" if all(checks.values()) else "FAILED", key, "OK", f"{root}/{key}", checks, proposal["n"])


def result_of(targets: DataFrame, evidence: DataFrame, workflow: str, validated_hash: str, *, status: str = "VALIDATED", artifact_hash: str | None = None, artifact_workflow: str | None = None) -> Result:
    """A result whose target rows are numbered and kept, as each check reads them."""
    return Result(workflow, kept(A.numbered_targets(targets)), evidence, status, validated_hash, validated_hash if artifact_hash is None else artifact_hash, artifact_workflow)
