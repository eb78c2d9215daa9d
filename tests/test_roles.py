"""Keys, targets, relations, events, slices, packages and vocabularies on small tables."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from larkspur.functions.columns import rounded
from larkspur.operators import catalog as C
from larkspur.operators import cross_section, slices
from larkspur.operators import roles as R
from larkspur.operators import scenario as S
from larkspur.operators import vocabulary as W
from larkspur.sources import packages as P


def test_header_roles():
    roles = {c: r for c, _, r in R.header_roles(["Event ID", "event time (UTC)", "Category", "category of event", "Дата ответа/закрытия", "DTI, %", "Риск–балл", "customer-id", "foo"])}
    assert roles == {"Event ID": "EVENT_ID", "event time (UTC)": "EVENT_TIMESTAMP", "Category": "EVENT_TYPE", "category of event": "OTHER", "Дата ответа/закрытия": "OTHER", "DTI, %": "DTI", "Риск–балл": "TARGET_NUMERIC", "customer-id": "ENTITY_ID", "foo": "OTHER"}
    request = ["request_id", "submitted_at", "status", "service_type"]
    assert R.column_of(request, "EVENT_TYPE") == "service_type" and R.column_of(request[1:], "EVENT_TYPE") == "status"
    assert R.column_of(["Статус", "Тип обращения"], "EVENT_TYPE") == "Тип обращения"
    with pytest.raises(ValueError):
        R.event_semantics(["event_id", "event_type"])


def test_entity_column(spark):
    rows = [(k, f"c{k % 9}", "x" if k else None, str(k)) for k in range(10)]
    df = spark.createDataFrame(rows, "row_id long, client string, account_id string, entity string")
    assert R.entity_column(df) == "row_id" and R.entity_column(df.drop("row_id")) == "entity"
    assert R.entity_column(df.select("client", "account_id")) == R.SOURCE_ROW == R.entity_column(spark.range(3).toDF("n"))
    assert R.entity_column(df.withColumn("row_id", F.when(F.col("row_id") > 0, F.col("row_id").cast("string")).otherwise(""))) == "entity"


def test_targets(spark):
    df = spark.createDataFrame([("1", "a", "2", "true", ""), ("2", "b", " 1 500", "false", "")], "id string, risk_category string, score string, flag string, churn_flag string")
    assert R.kinds(df) == {"id": "numeric", "risk_category": "categorical", "score": "numeric", "flag": "boolean", "churn_flag": "empty"}
    assert R.resolve_target(df) == R.Target("risk_category", "KNOWN_ALIAS", "CATEGORICAL", True)
    assert R.resolve_target(df, "score").kind == "NUMERIC"
    for no in ("id", "flag", "churn_flag", "absent"):
        assert R.resolve_target(df, no) == R.Target(None)


def people(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = [(k, rng.choice("abcc") if rng.random() < 0.9 else None, rng.choice(["x", "y", ""]), rng.random() * 10 if rng.random() < 0.8 else None, float(rng.randrange(50)) if rng.random() < 0.9 else None) for k in range(n)]
    return rows, spark.createDataFrame(rows, "client_id long, segment string, region string, income double, risk_score double")


def pearson(pairs):
    mx, my = statistics.fmean(a for a, _ in pairs), statistics.fmean(b for _, b in pairs)
    below = math.sqrt(sum((a - mx) ** 2 for a, _ in pairs) * sum((b - my) ** 2 for _, b in pairs))
    return sum((a - mx) * (b - my) for a, b in pairs) / below if below else 0.0


def test_relations_to_a_numeric_target(spark):
    rows, df = people(spark)
    section = cross_section.Section(df)
    assert (section.entity, section.target.column, section.numbers, section.classes) == ("client_id", "risk_score", ["income"], ["segment", "region"])
    got = {(r.method, r.predictor): (r.n, r.strength) for r in section.associations().collect()}
    pairs = [(r[3], r[4]) for r in rows if r[3] is not None and r[4] is not None]
    want = {("PEARSON", "income"): (len(pairs), abs(pearson(pairs)))}
    sd = statistics.pstdev(r[4] for r in rows if r[4] is not None)
    for at, name in ((1, "segment"), (2, "region")):
        groups = {}
        for r in rows:
            if r[at] and r[4] is not None:
                groups.setdefault(r[at], []).append(r[4])
        means = [statistics.fmean(v) for v in groups.values()]
        want["GROUP_MEAN_RANGE", name] = (sum(map(len, groups.values())), (max(means) - min(means)) / sd)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (want[k][0], pytest.approx(want[k][1]))
    ranks = [(r["rank"], r.method) for r in section.drivers().collect()]
    assert sorted(ranks)[0] == (1, "PEARSON") and len(ranks) == 3
    bound = sorted(r[4] for r in rows if r[4] is not None)
    bound = bound[math.ceil(len(bound) * 0.75) - 1]
    assert {int(r.entity_id) for r in section.high_risk("client_id").collect()} == {r[0] for r in rows if r[4] is not None and r[4] >= bound}


def test_contingency_has_cells(spark):
    rows, df = people(spark)
    section = cross_section.Section(df, "segment")
    cells = {(r.value, r.target_value): r.n for r in section.groups().filter("method = 'CONTINGENCY'").collect()}
    want = {}
    for r in rows:
        if r[1] and r[2]:
            want[r[2], r[1]] = want.get((r[2], r[1]), 0) + 1
    assert cells == want
    strengths = {(r.method, r.predictor): r.strength for r in section.associations().collect()}
    assert strengths["CONTINGENCY", "region"] is None and strengths["NUMERIC_BY_TARGET_GROUP", "income"] >= 0


def test_a_table_without_target_or_rows(spark):
    _, df = people(spark)
    for x in (df.drop("risk_score"), df.limit(0), spark.range(0).toDF("n")):
        section = cross_section.Section(x)
        assert section.associations().count() == section.groups().count() == section.drivers().count() == 0
        assert section.high_risk(x.columns[0]).count() == 0
        section.numeric_summaries().collect(), section.category_counts().collect(), section.prevalence().collect()


def test_normalized_events_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(None if k % 3 == 0 else f"e{k}", "2000-01-01 00:00:%02d" % (k % 60), None if k % 5 == 0 else " " if k % 5 == 1 else "u", "t", ["1", "NaN", "1e999", " 2.5 ", "", None, "x"][k % 7]) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id string, timestamp string, user_id string, event_type string, amount string").coalesce(1)
    df.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "a"))
    read = spark.read.parquet(str(tmp_path / "a"))
    key = lambda got: sorted((r.source_row, r.event_id, r.entity_id, r.micros, r.value) for r in got.collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in (before, "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(key(R.normalized_events(R.source_rows(read, "row"), R.event_semantics(read.columns), "row")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(k + 1, r[0] or f"ROW-{k + 1}", "u" if k % 5 > 1 else "ALL_EVENTS", 946684800000000 + k % 60 * 1000000, {0: 1.0, 3: 2.5}.get(k % 7)) for k, r in enumerate(rows)]
    assert found[0] == found[1] == want
    placed = df.withColumn("k", F.monotonically_increasing_id())
    for n in (1, 37):
        made = R.normalized_events(placed.repartitionByRange(n, "k").sortWithinPartitions("k").drop("k"))
        assert [x[:3] for x in key(made)] == [x[:3] for x in want]


def test_slices_name_what_differs(spark):
    rows = [(k, k % 5) for k in range(3000)]
    one = spark.createDataFrame(rows, "a long, b long")
    other = one.withColumn("b", F.when(F.col("a") == 77, 9).otherwise(F.col("b")))
    mine, theirs = (slices.artifact({"same": one, "rows": x, "sums": x.groupBy("b").count()}) for x in (other, one))
    assert {(r["slice"], r.passed) for r in slices.compare(mine.repartition(7), theirs.repartition(2)).collect()} == {("same", True), ("rows", False), ("sums", False)}
    got = {(r["slice"], r.row, r.claimed, r.recomputed) for r in slices.differences(mine, theirs).collect()}
    assert got == {("rows", '{"a":77,"b":9}', 1, 0), ("rows", '{"a":77,"b":2}', 0, 1), ("sums", '{"b":9,"count":1}', 1, 0), ("sums", '{"b":2,"count":600}', 0, 1), ("sums", '{"b":2,"count":599}', 1, 0)}
    # A row that stands twice is not the same as one.
    twice = slices.artifact({"rows": one.limit(3).union(one.limit(1))})
    assert {r.claimed - r.recomputed for r in slices.differences(twice, slices.artifact({"rows": one.limit(3)})).collect()} == {1}
    assert not slices.compare(mine, theirs.filter("slice <> 'same'")).filter("slice = 'same'").first().passed


def test_references_of_an_artifact(spark):
    part = slices.artifact({"x": spark.range(3)})
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "evidence_id string")
    check = lambda refs, held: slices.validate(part, part, refs, held).filter("check = 'EVIDENCE_REFERENCES'").first().passed
    assert check(ids("a", "a"), ids("a", "b")) and not check(ids("a", "c"), ids("a", "b")) and not check(ids("a"), ids("a", "a"))


SCENARIO = S.Scenario("load", 0, 20, 10, False, (S.Effect("load", "cost", 2.0, note="n"),), target="cost", threshold=90.0)


def test_packages_are_the_same_from_any_partitions(spark, tmp_path):
    rows = [(k, 50.0 + k, 100.0 if k % 2 else None) for k in range(40)]
    base = spark.createDataFrame(rows, "k long, load double, cost double")
    make = lambda n: P.packages(base.repartition(n), SCENARIO, "k", 10, F.lit("h"))
    one, many = ({r.k: r.package for r in make(n).collect()} for n in (1, 13))
    assert one == many and one[0] is None and '"baselineValue":51,' in one[1] and '"recommendedCandidate":{"baselineValue":51,"bounded":false,"changePct":10,' in one[1]
    path = str(tmp_path / "p")
    digest = P.write_packages(make(5), path)
    assert digest == P.verify_packages(make(3), path) and not os.path.exists(path + ".staged")
    with pytest.raises(ValueError):
        P.verify_packages(make(3).filter("k <> 1"), path)


def test_packages_round_ties_as_their_twin(spark):
    import duckdb

    values = [2912.1749999999997, 2912.175, -2912.1749999999997, 1.005, 1.115, 0.285, 24377.500000000007, -0.001, 0.0, 1e300, 1.7e308, None]
    got = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").orderBy("k").select(rounded(F.col("x"), 2).alias("r")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values] and got[0] == 2912.18
    # 3555.95 - 643.775 is 2912.1749999999997 in doubles.
    base = spark.createDataFrame([(1, 64377.5, 3555.95)], "k long, load double, cost double")
    chain = S.Scenario("load", 0, 100, 100, False, (S.Effect("load", "cost", 0.01, note="n"),), target="cost", threshold=0.0)
    assert '"simulatedValue":2912.18' in P.packages(base, chain, "k", 100, F.lit("h"), digits=2).first().package


def test_concepts_by_stage(spark):
    concepts = spark.createDataFrame([("lead_time", ["Lead Time", "срок поставки"], False), ("lead_time_gap", ["lead time gap"], False), ("stock", ["stock"], False), ("other", ["срок поставки"], False), ("whole", ["Grand-Total"], True)], "concept string, aliases array<string>, exact_only boolean")
    names = ["lead_time", "Lead Time", "LEAD-TIME", "lead time, days", "lead time gap (h)", "stock level", "Срок поставки", "Grand-Total", "grand total", "score", "", None, "Ｌead　Time"]
    got = {r.name: (r.method, r.concept, list(r.candidates)) for r in W.resolve_columns(spark.createDataFrame([(n,) for n in names + names], "name string"), concepts).collect()}
    none = ("UNRESOLVED", None, [])
    assert got["lead_time"] == ("EXACT_CANONICAL", "lead_time", ["lead_time"]) and got["Lead Time"][0] == "EXACT_ALIAS" and got["LEAD-TIME"][:2] == ("NORMALIZED_ALIAS", "lead_time")
    assert got["lead time, days"][:2] == ("PREFIX_ALIAS", "lead_time") and got["lead time gap (h)"][:2] == ("PREFIX_ALIAS", "lead_time_gap") and got["Ｌead　Time"][0] == "NORMALIZED_ALIAS"
    assert got["Срок поставки"] == ("AMBIGUOUS", None, ["lead_time", "other"])
    # A short alias is no prefix, one for whole names none either.
    assert got["stock level"] == got["grand total"] == got["score"] == got[""] == none and got["Grand-Total"][0] == "EXACT_ALIAS"


def test_short_lists_never_split_a_tie(spark):
    concepts = spark.createDataFrame([(f"c{k:02d}", ["alpha beta"] if k < 3 else ["alpha"], [], "NUMERIC", "", False) for k in range(18)] + [("days", ["zzz"], [], "NUMERIC", "DAYS", False), ("share", ["alpha beta gamma"], [], "NUMERIC", "PERCENTAGE", False), ("text", ["alpha beta gamma"], [], "TEXT", "", False)], "concept string, texts array<string>, aliases array<string>, data_type string, family string, exact_only boolean")
    facts = (10, 10, 10, 10, 0, True, True, 500.0, "numeric")
    columns = spark.createDataFrame([("t", "alpha", "beta", *facts), ("t", "gamma", "sutok дней", *facts), ("t", "empty alpha", "", 0, 10, 0, 0, 0, True, True, None, "empty")], "table string, name string, context string, n long, n_rows long, unique long, numbers long, dates long, positive boolean, whole boolean, high double, kind string")
    got = {}
    for r in W.shortlist(columns, concepts, ["table", "name"]).collect():
        got.setdefault(r.name, []).append((r["rank"], r.concept, r.score))
    # Fifteen concepts share the next score; with the three before them they would be 18.
    assert sorted(got["alpha"]) == [(1, "c00", 2), (2, "c01", 2), (3, "c02", 2)]
    # A percentage above 100 is contradicted by the cells; a unit word is enough.
    assert got["gamma"] == [(1, "days", 3)] and "empty alpha" not in got
    assert len(W.shortlist(columns, concepts, ["table", "name"], most=18).filter("name = 'alpha'").collect()) == 18


def test_domains_of_many_tables(spark):
    tables = {"r": ["units_sold", "Inventory", "Gross Margin %", "x"], "l": ["units_sold", "demand"], "m": ["OEE", "defect rate", "units_sold", "inventory", "gross_margin"], "none": ["x"]}
    heads = spark.createDataFrame([(t, c) for t, cs in tables.items() for c in cs], "t string, name string")
    got = {(r.t, r.domain): (r.metrics, r.score, r.eligible, r.status) for r in W.resolve_schemas(heads, C.aliases(spark), C.hints(spark), ["t"]).collect()}
    assert got["r", "RETAIL"] == (3, 18, True, "RESOLVED") and got["l", "RETAIL"] == (2, 9, False, None)
    assert got["m", "RETAIL"][1:] == (18, True, "AMBIGUOUS") and got["m", "MANUFACTURING"][1] == 16 and got["m", "MANUFACTURING"][2] is False and not any(t == "none" for t, _ in got)
