"""Queries on exports of decisions and on the rules that allow them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.canonical import digest_of, row_json
from larkspur.functions.checkpoints import kept, shared_dir
from larkspur.operators import actions as A
from larkspur.operators import events as E
from larkspur.plans import views as V
from larkspur.plans.investigation_queries import _FLAGS, _LOG
from larkspur.sources import decisions as D
from larkspur.sources.stores import Store, placed_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENTS = "event-transaction-investigation"


def _exported(s: SparkSession, d: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What an export of the notable events has written, read back."""
    log = kept(V.event_log(s, d))
    version = log.agg(digest_of(row_json(log)).alias("v")).first()["v"]
    targets = A.event_targets(E.reason_texts(E.notable(log)))
    result = D.result_of(targets, s.createDataFrame([(f"E-{k:03d}",) for k in range(1, 8)], "evidence_id string"), EVENTS, version)
    root = f"{shared_dir(s).rstrip('/')}/decisions-{uuid.uuid4().hex}"
    try:
        record = D.exported(result, root, "2001-01-01T00:00:00.000Z")
        if record.status != "VERIFIED":
            raise ValueError(f"the export is {record.status}: {record.policy}, {record.checks}")
        return kept(read(record.path))
    finally:
        Store(s, root).delete(root)


QUERIES["flagged_events_csv"] = lambda s, d: _exported(s, d, lambda path: placed_lines(s, f"{path}/{D.ROWS_FILE[EVENTS]}"))
QUERIES["validated_decision"] = lambda s, d: _exported(s, d, lambda path: placed_lines(s, f"{path}/{D.DECISION_FILE}"))
_SENTENCES = """list_transform(string_split(n.reasons, ','), lambda r: CASE r WHEN 'rare' THEN 'тип события «' || log.event_type || '» встречается не чаще опубликованного порога 5%' WHEN 'odd' THEN 'значение выходит за опубликованные границы 1.5×IQR'
  WHEN 'burst' THEN 'событие входит в скопление одной сущности минимум из трёх событий с промежутками не более пяти минут' ELSE 'событие повторяет ту же сущность/тип/значение в течение пяти минут' END)"""
_TARGETS = f"{_LOG}, {_FLAGS}, targets AS (SELECT n.event_id AS id, row_number() OVER (ORDER BY n.source_row) AS place, array_to_string({_SENTENCES}, '; ') AS why FROM notable n JOIN log USING (event_id))"
SQL["flagged_events_csv"] = f"""{_TARGETS} SELECT CAST(0 AS BIGINT) AS position, 'id,reasons,evidence_refs' AS line
UNION ALL SELECT place, id || ',' || CASE WHEN regexp_matches(why, '[",]') THEN '"' || replace(why, '"', '""') || '"' ELSE why END || ',E-006' FROM targets"""
SQL["validated_decision"] = f"""{_TARGETS}, total AS (SELECT count(*) AS n FROM targets),
ver AS (SELECT CAST(count(*) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substr(md5('{{"entity_id":' || to_json(entity_id) || ',"event_id":' || to_json(event_id) || ',"event_type":' || to_json(event_type) || ',"micros":' || micros || ',"source_row":' || source_row || ',"value":' || CAST(value AS BIGINT) || '}}'), 1, 15)) AS HUGEINT)) AS VARCHAR) AS hash FROM log),
head AS (SELECT unnest(['{{', '  "actionId": "A-001",', '  "type": "EXPORT_DECISION",', '  "workflowId": "event-transaction-investigation",', '  "validationStatus": "VALIDATED",', '  "validatedArtifactHash": "' || hash || '",', '  "target": "notable_events",', '  "targetIds": [']) AS line, unnest(range(8)) AS position FROM ver),
tail AS (SELECT unnest(['  ],', '  "evidenceRefs": ["E-006"],', '  "reason": "Export the ' || n || ' source ' || CASE WHEN n = 1 THEN 'event' ELSE 'events' END || ' that matched at least one validated deterministic attention rule, with their supporting Evidence references.",', '  "generatedAt": "2001-01-01T00:00:00.000Z"', '}}']) AS line, unnest(range(5)) + 8 + n AS position FROM total)
SELECT CAST(position AS BIGINT) AS position, line FROM head UNION ALL SELECT CAST(position AS BIGINT), line FROM tail
UNION ALL SELECT CAST(7 + place AS BIGINT), '    ' || CAST(to_json(id) AS VARCHAR) || CASE WHEN place < n THEN ',' ELSE '' END FROM targets, total"""


def _proposals(s: SparkSession, d: str) -> DataFrame:
    """One proposal an order, with every kind of fault in some of them."""
    k = F.col("o_orderkey")
    workflow = F.element_at(F.array(*[F.lit(w) for w in A.TARGETS]), (k % 3 + 1).cast("int"))
    target = F.element_at(F.array(*[F.lit(t[0]) for t in A.TARGETS.values()]), (k % 3 + 1).cast("int"))
    digest = F.concat(F.lit("1-"), k.cast("string"))
    return V.table(s, d, "orders").select(
        k.cast("string").alias("subject"),
        F.when(k % 53 == 3, "DELETE").otherwise(A.ACTION).alias("type"),
        F.when(k % 59 == 4, "unknown-investigation").otherwise(workflow).alias("workflow_id"),
        F.when(k % 61 == 5, "all_rows").when(k % 67 == 6, "priority_interventions").when(k % 71 == 7, "").otherwise(target).alias("target"),
        F.when(k % 73 == 8, F.lit(None)).when(k % 11 == 9, F.concat(F.lit("This order causes a delay of "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("Export of "), F.col("o_orderpriority"))).alias("reason"),
        F.when(k % 79 == 10, F.lit(None)).otherwise(F.array(F.lit("E-1"), F.concat(F.lit("E-"), (k % 3 + 1).cast("string")))).alias("evidence_refs"),
        F.when(k % 13 == 11, "stale").otherwise("h").alias("validated_hash"),
        F.when(k % 17 == 12, "0-0").otherwise(digest).alias("target_digest"),
        F.when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("VALIDATED").alias("validation_status"),
        F.when(k % 19 == 13, "other-investigation").otherwise(workflow).alias("artifact_workflow"),
        workflow.alias("expected_workflow"),
        target.alias("artifact_target"),
        F.lit("h").alias("artifact_validated_hash"),
        F.when(k % 23 == 14, "changed").otherwise("h").alias("artifact_hash"),
        digest.alias("artifact_target_digest"),
        (k % 7 == 2).alias("executed"),
    )


def _cited(s: SparkSession, d: str) -> DataFrame:
    """An order's evidence: one for each of its lines."""
    return V.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("subject"), F.concat(F.lit("E-"), F.col("l_linenumber").cast("string")).alias("evidence_id"))


QUERIES["action_policy"] = lambda s, d: A.policy(_proposals(s, d), _cited(s, d)).select("subject", "allowed", "status", "reason_code")
SQL["action_policy"] = """
WITH p AS (SELECT *, o_orderkey AS k, ['cross-sectional-investigation', 'event-transaction-investigation', 'generic-time-series-investigation'][o_orderkey % 3 + 1] AS flow, ['highlighted_entities', 'notable_events', 'leading_signals'][o_orderkey % 3 + 1] AS goal FROM orders),
q AS (SELECT k, flow, goal, o_orderstatus, CASE WHEN k % 59 = 4 THEN 'unknown-investigation' ELSE flow END AS w, CASE WHEN k % 61 = 5 THEN 'all_rows' WHEN k % 67 = 6 THEN 'priority_interventions' WHEN k % 71 = 7 THEN '' ELSE goal END AS t,
  NOT (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = 1) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = k % 3 + 1)) AS unknown FROM p),
c AS (SELECT k, CASE WHEN t = '' OR k % 73 = 8 OR k % 79 = 10 THEN 'SCHEMA_INVALID' WHEN o_orderstatus = 'P' THEN 'VALIDATION_NOT_PASSED' WHEN k % 53 = 3 THEN 'ACTION_TYPE_NOT_ALLOWED' WHEN k % 59 = 4 THEN 'WORKFLOW_NOT_ELIGIBLE'
  WHEN t <> goal AND NOT (t = 'priority_interventions' AND k % 3 = 1) THEN 'INVALID_TARGET' WHEN unknown THEN 'INVALID_EVIDENCE_REFERENCE' WHEN k % 19 = 13 THEN 'WORKFLOW_MISMATCH' WHEN k % 23 = 14 OR k % 13 = 11 THEN 'ARTIFACT_HASH_MISMATCH'
  WHEN t <> goal THEN 'INVALID_TARGET' WHEN k % 17 = 12 THEN 'INVALID_TARGET_ID' WHEN k % 11 = 9 THEN 'CAUSAL_OVERCLAIM_IN_REASON' WHEN k % 7 = 2 THEN 'DUPLICATE_EXECUTION' ELSE 'OK' END AS reason_code FROM q)
SELECT CAST(k AS VARCHAR) AS subject, reason_code = 'OK' AS allowed, CASE WHEN reason_code = 'OK' THEN 'POLICY_APPROVED' ELSE 'REJECTED' END AS status, reason_code FROM c"""
