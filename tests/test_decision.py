"""Identity, inference, scenario, profile and source rules against twins and hand-made cases."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_replenishment import SF, oracle, rows_of  # noqa: F401

from larkspur.operators import identity, inference, scenario, series, validation
from larkspur.plans import decision_queries as Q
from larkspur.sources import delimited, sinks, workbook
from larkspur.streaming import bursts


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_twin(spark, oracle, name):  # noqa: F811
    got = Q.QUERIES[name](spark, SF)
    want = oracle.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_identity_cascade(spark):
    known = spark.createDataFrame([("s1", "Dark Roast Coffee 250 g pack"), ("s2", "Green Leaf Tea 100 g box"), ("s3", "Same Name Product 5 kg"), ("s4", "same  name product 5 KG"), ("s5", "Very Long Biscuit Name Alpha 1"), ("s6", "Very Long Biscuit Name Alphb 1")], "sku string, product_name string")
    asked = spark.createDataFrame([(x,) for x in ["dark roast  coffee 250 g PACK", "pack coffee, dark roast 250 g", "Dark Roast Cofee 250 g pack", "Dark Roast Coffee 500 g pack", "Same name product 5 kg", "Very Long Biscuit Name Alphc 1", "", None, "tea"]], "product_name string")
    got = {r.norm: (r.found, r.sku) for r in identity.resolve(asked, known).collect()}
    assert got == {
        "dark roast coffee 250 g pack": (True, "s1"),
        "pack coffee, dark roast 250 g": (True, "s1"),
        "dark roast cofee 250 g pack": (True, "s1"),
        "dark roast coffee 500 g pack": (False, None),
        "same name product 5 kg": (True, None),
        "very long biscuit name alphc 1": (True, None),
        "": (False, None),
        "tea": (False, None),
    }


def test_coded_rows_keep_their_sku(spark):
    known = spark.createDataFrame([("s1", "Apple")], "sku string, product_name string")
    rows = spark.createDataFrame([("e1", "apple"), ("e2", "Pear"), (None, "pear"), ("", "APPLE"), (None, "plum")], "sku string, product_name string")
    got = sorted((r.product_name, r.resolved) for r in identity.reconcile(rows, known).collect())
    assert got == [("APPLE", "s1"), ("Pear", "e2"), ("apple", "s1"), ("pear", "e2"), ("plum", None)]


def test_p_values():
    """Against a sum over the density of r on a fine grid."""
    for r, n in [(0.0, 10), (0.5, 6), (-0.5, 20), (0.9, 30), (0.2, 200)]:
        grid = np.linspace(-1, 1, 2_000_001)
        density = np.maximum(1 - grid * grid, 0) ** ((n - 4) / 2)
        want = density[np.abs(grid) >= abs(r)].sum() / density.sum()
        assert inference.two_tailed(np.array([r]), np.array([n]))[0] == pytest.approx(want, rel=1e-4, abs=1e-9)
    assert np.isnan(inference.two_tailed(np.array([0.5]), np.array([5]))[0])


def test_draws_follow_the_generator():
    state, want = 12345, []
    for _ in range(50):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (1 | state) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF
        want.append((t ^ t >> 14) / 4294967296)
    assert inference.draws(12345, 50).tolist() == want


def test_bootstrap_of_a_line():
    x = np.arange(20.0)
    assert inference.block_bootstrap(x, 2 * x, "k")[3:] == (400, "STABLE")
    assert inference.block_bootstrap(x[:5], x[:5], "k")[3:] == (0, "UNSTABLE")


def test_precursors(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.precursor_chain(spark, sf).collect()
    assert 0 < len(got) <= 5 and [r.lag for r in got] == sorted((r.lag for r in got), reverse=True)
    assert all(r.stable_low <= r["median"] <= r.stable_high and r.low <= r.r <= r.high for r in got)
    assert {r.anchor for r in Q.precursor_chain(spark, sf, "customers").collect()} == {"customers"}


def test_lags_against_plain_pairs(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=60)
    wide = {"a": a, "b": np.roll(a, 2) + rng.normal(size=60) / 5, "c": np.r_[rng.normal(size=59), 9.0], "d": rng.normal(size=60), "flat": np.ones(60)}
    for name in wide:
        wide[name] = [None if rng.random() < 0.1 and k < 59 else float(v) for k, v in enumerate(wide[name])]
    wide["a"][59] = wide["b"][59] = 7.0
    wide["d"] = [*wide["d"][:4], *[None] * 55, 5.0]
    frame = spark.createDataFrame(list(zip(range(60), *wide.values())), "idx long, " + ", ".join(f"{k} double" for k in wide))
    found = series.findings(frame, list(wide))
    z = {k: (vs[-1] - np.mean(vs)) / np.std(vs) if np.std(vs) else 0.0 for k, v in wide.items() for vs in [[x for x in v if x is not None]]}
    want = sorted((k for k in z if abs(z[k]) >= 1), key=lambda k: -abs(z[k]))
    assert [r.signal for r in found.orderBy("rank").collect()] == want and {"a", "b", "c"} <= set(want)
    for target in (None, "b", "absent"):
        anchor = target if target in wide else want[0]
        got = {(r.signal, r.lag): (r.anchor, r.n, r.r) for r in series.lags(frame, list(wide), found, target).collect()}
        plain = {}
        for k in want:
            for lag in range(4) if k != anchor else ():
                pairs = [(x, y) for x, y in zip(wide[k], wide[anchor][lag:]) if x is not None and y is not None]
                if len(pairs) < 5:
                    break
                r = np.corrcoef(np.array(pairs).T)[0, 1] if len({x for x, _ in pairs}) > 1 else 0.0
                plain[k, lag] = (anchor, len(pairs), pytest.approx(r))
        assert got == plain
    assert series.chain(frame.limit(0), list(wide)).count() == 0
    assert tuple(series.risk(series.edges(series.lags(frame.limit(2), list(wide), series.findings(frame.limit(2), list(wide))))).first()) == (0.0, "LOW")


def test_scenario_must_be_a_chain(spark):
    with pytest.raises(ValueError):
        scenario.Scenario("a", 0, 10, 1, True, (scenario.Effect("b", "c", 1.0, note="x"),)).validate()
    s = scenario.Scenario("a", 0, 100, 50, True, (scenario.Effect("a", "b", -1.0, note="x"),), (scenario.Bound("b", 0.0),), cap="top", target="b", threshold=1.0)
    rows = spark.createDataFrame([(1, 10.0, 12.0, 11.0), (2, 10.0, 5.0, 100.0), (3, None, 5.0, 100.0)], "k int, a double, b double, top double")
    got = {(r.k, r.change_pct): (r.available, r.bounded, r.a_after, r.b_after) for r in scenario.sweep(rows, s).collect()}
    assert got[1, 50.0] == (True, True, 11.0, 11.0) and got[2, 50.0] == (True, False, 15.0, 0.0) and got[2, 100.0] == (True, True, 20.0, 0.0)
    assert got[3, 0.0] == (False, None, None, None)


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id; name ;\r\n1;"a;""b""\nc" ;x\r\n;;\r\n2;,,,;\r\n', encoding="utf-8")
    got = delimited.scan(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "name", "column_3"]
    assert sorted(tuple(r) for r in got.collect()) == [("1", 'a;"b"\nc', "x"), ("2", ",,,", None)]
    with pytest.raises(ValueError):
        delimited.headers(["a", " a"])
    assert delimited.delimiter('"a;b;c",d') == ","


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>SKU</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3" outlineLevel="2"><c r="A3"><v>1.5</v></c><c r="B3"><v>7</v></c><c r="C3" s="1"><v>36526</v></c><c r="D3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    got = [(r.sheet, r.row, r.level, r.cells) for r in workbook.scan(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()]
    assert got == [("S", 1, 0, ["SKU", None, "ab"]), ("S", 3, 2, ["1.5", "7", "2000-01-01T00:00:00.000Z", "true"])]


def test_order_files(spark, tmp_path):
    lines = spark.createDataFrame([("A", "k2", '=x"', 5.0, 6.5, "high"), ("A", "k1", "n", 5.0, 6.0, "low"), ("B", "k", "n", 1.0, 0.0, "low")], "supplier string, sku string, product_name string, recommended double, quantity double, urgency string")
    sinks.write_orders(lines, "2000-12", str(tmp_path / "o"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "o" / "folder=A").glob("part-*")))
    assert text.startswith('﻿"Поставщик";"SKU"') and text.split("\r\n")[1:3] == ['"A";"k1";"n";"5";"6";"low";"2000-12"', '"A";"k2";"\'=x""";"5";"6.5";"high";"2000-12"']
    assert not (tmp_path / "o" / "folder=B").exists()
    assert sinks.write_verified(lines, str(tmp_path / "j"))["rows"] == 3


def test_validation(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = a.repartition(3)
    assert validation.same_rows(a, b) and validation.fingerprint(a) == validation.fingerprint(b)
    assert not validation.same_rows(a, a.distinct()) and validation.unresolved(a, a.filter("k = 1"), "k").count() == 1
    with pytest.raises(ValueError):
        validation.publish(a.distinct(), validation.fingerprint(a))


def test_stream_bursts(spark, tmp_path):
    rows = [("u", f"2000-01-01 00:0{m}:00") for m in (0, 3, 8)] + [("u", "2000-01-01 01:00:00"), ("v", "2000-01-02 00:00:00")]
    spark.createDataFrame(rows, "entity string, t string").select("entity", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = [tuple(r) for r in bursts.bursts(spark.read.parquet(str(tmp_path / "in")), ["entity"]).select("entity", "n").collect()]
    assert batch == [("u", 3)]
    stream = spark.readStream.schema("entity string, ts timestamp").parquet(str(tmp_path / "in"))
    query = bursts.bursts(stream, ["entity"]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.entity, r.n) for r in spark.table("found").collect()] == [("u", 3)]
