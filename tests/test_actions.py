"""Exports of decisions: files, checks, ledger and faults; rules of the policy."""

import json
import os

import pytest

from larkspur.functions.canonical import canonical, digest_of, number_text, ordered_digest_of, row_json
from larkspur.functions.rownumbers import numbered
from larkspur.operators import actions as A
from larkspur.sources import decisions as D
from larkspur.sources.stores import Store, placed_lines, write_lines
from pyspark.sql import functions as F

CS = "cross-sectional-investigation"


def entities(spark, n=7, workflow=CS, **more):
    rows = [(k, f'id "{k}"' if k % 3 == 0 else f"c,{k}", [f"reason {k}", "line\nfeed"]) for k in range(n)]
    targets = A.entity_targets(spark.createDataFrame(rows, "position long, entity_id string, reasons array<string>").repartition(3))
    evidence = spark.createDataFrame([("E-001",), ("E-005",)], "evidence_id string")
    return D.result_of(targets, more.pop("evidence", evidence), workflow, more.pop("validated_hash", "h1"), **more)


def text_of(folder):
    return "".join(open(f"{folder}/{x}").read() for x in sorted(os.listdir(folder)) if x.startswith("part-"))


def test_files_and_a_second_run_that_writes_nothing(spark, tmp_path):
    result, root = entities(spark), str(tmp_path / "out")
    record = D.exported(result, root, "now")
    assert record.status == "VERIFIED" and list(record.checks) == list(D.CHECKS) and all(record.checks.values()) and record.rows == 7
    decision = json.loads(text_of(f"{record.path}/{D.DECISION_FILE}"))
    assert list(decision) == ["actionId", "type", "workflowId", "validationStatus", "validatedArtifactHash", "target", "targetIds", "evidenceRefs", "reason", "generatedAt"]
    assert decision["targetIds"] == [f'id "{k}"' if k % 3 == 0 else f"c,{k}" for k in range(7)] and decision["evidenceRefs"] == ["E-005"]
    assert text_of(f"{record.path}/flagged_entities.csv").startswith('id,reasons,evidence_refs\n"id ""0""","reason 0; line\nfeed",E-005\n"c,1",')
    before = {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(root) for p in (f"{d}/{f}" for f in fs)}
    assert D.exported(result, root, "later").status == "VERIFIED"
    again = D.export(result, root, "later")
    assert (again.status, again.policy) == ("REJECTED", "DUPLICATE_EXECUTION")
    assert before == {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(root) for p in (f"{d}/{f}" for f in fs)}
    assert D.exported(entities(spark, validated_hash="h2"), root, "now").path != record.path


def test_faults_between_the_phases_are_recovered(spark, tmp_path, monkeypatch):
    result, root = entities(spark), str(tmp_path / "out")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "rename", broken)
        with pytest.raises(OSError):
            D.exported(result, root, "now")
    assert os.path.isdir(f"{root}/_staged/{result.key}") and not os.path.exists(f"{root}/{result.key}")
    with monkeypatch.context() as m:
        m.setattr(Store, "write", broken)
        with pytest.raises(OSError):
            D.exported(result, root, "now")
    # Finished files without an entry are verified and entered, not written again.
    made = {f: os.stat(f"{root}/{result.key}/{f}").st_mtime_ns for f in os.listdir(f"{root}/{result.key}")}
    assert D.exported(result, root, "now").status == "VERIFIED"
    assert made == {f: os.stat(f"{root}/{result.key}/{f}").st_mtime_ns for f in os.listdir(f"{root}/{result.key}")}
    assert json.load(open(f"{root}/_ledger/{result.key}.json"))["rows"] == 7
    # Finished files that are not what they should be are replaced if there is no entry.
    os.remove(f"{root}/_ledger/{result.key}.json")
    write_lines(spark.createDataFrame([(0, "x")], "position long, line string"), f"{root}/{result.key}/{D.DECISION_FILE}")
    assert D.exported(result, root, "now").status == "VERIFIED" and "targetIds" in text_of(f"{root}/{result.key}/{D.DECISION_FILE}")


def rewritten(spark, path, change):
    """Files whose text is changed."""
    lines = change("\n".join(r.line for r in placed_lines(spark, path).orderBy("position").collect())).split("\n")
    write_lines(spark.createDataFrame(list(enumerate(lines)), "position long, line string"), path)


def test_each_check_fails_alone_or_with_what_follows_from_it(spark, tmp_path):
    result, root = entities(spark), str(tmp_path / "out")
    path = D.exported(result, root, "now").path
    proposal = A.propose(result.rows, CS, "h1").first()
    failed = lambda **more: {k for k, ok in D.verify(more.get("result", result), more.get("proposal", proposal), path).items() if not ok}
    assert failed() == set()
    decision, csv = f"{path}/{D.DECISION_FILE}", f"{path}/flagged_entities.csv"

    def spoilt(file, before, after):
        rewritten(spark, file, lambda t: t.replace(before, after))
        got = failed()
        rewritten(spark, file, lambda t: t.replace(after, before))
        assert failed() == set()
        return got

    assert spoilt(decision, '"c,1"', '"c,one"') == {"TARGET_IDS_MATCH"}
    assert spoilt(decision, '    "c,1",\n    "c,2",', '    "c,2",\n    "c,1",') == {"TARGET_IDS_MATCH"}
    assert spoilt(decision, '"validatedArtifactHash": "h1"', '"validatedArtifactHash": "h9"') == {"ARTIFACT_HASH_MATCHES"}
    assert spoilt(decision, "Export the 7", "Export the 8") == {"JSON_REASON_MATCHES"}
    assert spoilt(decision, '"target": "highlighted_entities"', '"target": "notable_events"') == {"EXPORT_CONTRACT_MATCHES"}
    assert spoilt(decision, '["E-005"]', '["E-001"]') == {"EXPORT_CONTRACT_MATCHES"}
    assert spoilt(csv, "reason 4", "reason four") == {"CSV_CONTENT_MATCHES"}
    assert spoilt(csv, '"c,5",', '"c,5",more\n"c,5",') == {"CSV_CONTENT_MATCHES", "ROW_COUNT_MATCHES"}
    assert {"EVIDENCE_REFS_EXIST", "ARTIFACT_POLICY"} == failed(result=entities(spark, evidence=spark.createDataFrame([("E-001",)], "evidence_id string")))
    assert {"VALIDATION_STATUS_VALIDATED", "ARTIFACT_POLICY"} == failed(result=entities(spark, status="BLOCKED"))
    assert {"ARTIFACT_POLICY"} == failed(result=entities(spark, artifact_hash="other"))
    Store(spark, root).delete(csv)
    assert {"ARTIFACTS_PRESENT", "ROW_COUNT_MATCHES", "CSV_CONTENT_MATCHES"} == failed()
    assert D.exported(result, root, "now").status == "FAILED"
    Store(spark, root).delete(decision)
    assert "ARTIFACTS_PRESENT" in failed()


def test_refused_results_write_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    for more, code in (({"status": "BLOCKED"}, "VALIDATION_NOT_PASSED"), ({"artifact_hash": "x"}, "ARTIFACT_HASH_MISMATCH"), ({"artifact_workflow": "event-transaction-investigation"}, "WORKFLOW_MISMATCH"), ({"validated_hash": ""}, "ARTIFACT_HASH_MISMATCH")):
        assert D.exported(entities(spark, **more), root, "now").policy == code
    assert not os.path.exists(root)


def test_leading_signals_and_no_rows(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a b", "c", 2, 0.5, 1e-7, True, 30, 0.25, 0.75), (2, "d", "c", 0, -1.0, None, False, 5, None, None)], "position long, source string, target string, lag int, correlation double, p_value double, significant boolean, n long, ci_low double, ci_high double")
    none = spark.createDataFrame([], "evidence_id string")
    record = D.exported(D.result_of(A.signal_targets(edges), none, A.SERIES, "h"), str(tmp_path / "out"), "now")
    assert record.status == "VERIFIED"
    assert text_of(f"{record.path}/leading_signals.csv").splitlines()[1:] == ["a%20b::c::2,a b,c,2,0.5,1e-7,true,30,0.25,0.75", "d::c::0,d,c,0,-1,,false,5,,"]
    empty = D.exported(D.result_of(A.signal_targets(edges.limit(0)), none, A.SERIES, "h2"), str(tmp_path / "out"), "now")
    assert empty.status == "VERIFIED" and json.loads(text_of(f"{empty.path}/{D.DECISION_FILE}"))["targetIds"] == []


def test_every_refusal_occurs_in_the_policy_query(spark):
    from larkspur.plans import action_queries

    found = {r.reason_code for r in action_queries.QUERIES["action_policy"](spark, "/root/testdata/sf0.01").select("reason_code").distinct().collect()}
    assert found == {*A.REFUSALS, "OK"}


def test_canonical_texts(spark):
    df = spark.createDataFrame([({"b": [1.0, 2.5], "a": [None]}, (True, 'x"\\\n'), 3)], "m map<string,array<double>>, s struct<z:boolean,y:string>, k int")
    assert df.select(row_json(df)).first()[0] == '{"k":3,"m":{"a":[null],"b":[1,2.5]},"s":{"y":"x\\"\\\\\\n","z":true}}'
    values = [0.0, -0.0, 1.0, -12.5, 1e21, 1.5e300, 123456789.125, 12345678901234567890.0, 1e-6, 1.25e-7, 0.001, 1e15, 0.1 + 0.2, float("nan"), float("inf"), None]
    want = ["0", "0", "1", "-12.5", "1e+21", "1.5e+300", "123456789.125", "12345678901234567000", "0.000001", "1.25e-7", "0.001", "1000000000000000", "0.30000000000000004", "null", "null", "null"]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    assert [r[0] for r in frame.orderBy("k").select(canonical(F.col("x"), frame.schema["x"].dataType)).collect()] == want
    empty = spark.sql("select cast(null as struct<a:int>) as s, cast(null as array<int>) as a, cast(null as map<string,int>) as m")
    assert empty.select(row_json(empty)).first()[0] == '{"a":null,"m":null,"s":null}'
    with pytest.raises(TypeError):
        canonical(F.col("x"), spark.sql("select interval 1 month as x").schema["x"].dataType)
    assert spark.range(1).select(number_text(F.lit(2.5))).first()[0] == "2.5"


def test_digests_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("t"))
    one, many = ({df.repartition(n).agg(digest_of(F.col("t")), ordered_digest_of(F.col("id"), F.col("t"))).first() for n in p} for p in ((1,), (3, 37)))
    assert one == many
    swapped = df.withColumn("id", 499 - F.col("id")).agg(digest_of(F.col("t")), ordered_digest_of(F.col("id"), F.col("t"))).first()
    assert swapped[0] == next(iter(one))[0] and swapped[1] != next(iter(one))[1]


def test_row_numbers_follow_partitions(spark):
    df = spark.range(1000).repartitionByRange(13, "id").sortWithinPartitions("id").withColumns({"_part": F.lit(1), "_before": F.lit(2)})
    got = numbered(df, "n", first=5)
    assert got.columns == ["id", "_part", "_before", "n"] and got.filter("n <> id + 5").isEmpty() and got.count() == 1000
    assert numbered(df.limit(0), "n").count() == 0
