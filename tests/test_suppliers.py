"""From sheets of suppliers to a recommendation; hierarchical reports; text rules."""

import glob

import pytest
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.sources import reports as R
from larkspur.sources import sinks, suppliers
from larkspur.streaming import bursts  # noqa: F401


def book(spark, *rows, levels=None):
    cells = [(0, k, (levels or {}).get(k, 0), [None if c is None else str(c) for c in r]) for k, r in enumerate(rows, 1)]
    return spark.createDataFrame(cells, "sheet_no int, row int, level int, cells array<string>")


def test_grouped_reports(spark):
    coded = book(spark, ["Период: 01.03.2024 - 31.03.2024"], ["Номенклатура, Артикул", None, "Количество"], ["Group"], ["Sweet, 150 g, A1", None, "3"], ["Sour, B2", None, "1,5"], ["Sweet again, A1", None, "2"], ["No quantity, C3", None, None], levels={3: 1, 4: 2, 5: 2, 6: 2, 7: 2})
    rows = R.grouped(coded)
    assert [(r.sku, r.product_name, r.month, r.units) for r in rows.orderBy("row").collect()] == [("A1", "Sweet, 150 g", "2024-03", 3.0), ("B2", "Sour", "2024-03", 1.5), ("A1", "Sweet again", "2024-03", 2.0)]
    assert sorted(tuple(r) for r in R.grouped_totals(rows).collect()) == [("A1", "Sweet, 150 g", "2024-03", 5.0), ("B2", "Sour", "2024-03", 1.5)]
    bare = book(spark, [None, "март 2026", None, "Итого"], ["Номенклатура", "Количество", None, "Количество"], ["x"], ["Sweet, 150 g", "4", None, "9"], levels={3: 1, 4: 2})
    assert [(r.sku, r.product_name, r.month, r.units) for r in R.grouped(bare).collect()] == [(None, "Sweet, 150 g", "2026-03", 4.0)]
    with pytest.raises(ValueError):
        R.grouped(book(spark, ["Период: 01.03.2024 - 30.04.2024"], ["Количество"], levels={2: 1}))
    with pytest.raises(R.MissingColumn):
        R.grouped(book(spark, ["март 2026"], ["Количество"], ["a"]))


def files(spark):
    months = ["Янв 2024", "Фев 2024", "Март 2024", "Апр 2024", "Май 2024", "Июн 2024"]
    return {
        "monthly": [book(spark, ["Код", "Наименование", *months], ["a", "Apple juice", *[100] * 6], ["b", "Bread", *[10] * 6]), book(spark, ["июль 2024"], ["Номенклатура", "Количество"], ["apple JUICE", 100], ["Unknown thing", 7], levels={3: 1, 4: 1})],
        "opening": [book(spark, ["Код", "Наименование", "Июн 2024", "Июль 2024"], ["a", "Apple juice", 50, 30], ["b", "Bread", 5, 400])],
        "multiples": [book(spark, ["Код 1с", "Наименование", "Кратность"], ["a", "Apple juice", 50])],
        "stock": [book(spark, ["Код 1с", "Наименование", "Остаток"], ["b", "Bread", 3])],
    }


def test_files_to_a_recommendation(spark):
    one = suppliers.load("First", files(spark), today="2024-08-01")
    assert [r.product_name for r in one["unmatched"].collect()] == ["Unknown thing"]
    assert {(r.sku, r.month): r.units_sold for r in one["monthly"].collect()}[("a", "2024-07")] == 100.0
    two = suppliers.load("Second", files(spark), today="2024-08-01")
    both = suppliers.union([one, two])
    assert suppliers.as_of_month(both, "2030-01") == "2024-07" and suppliers.as_of_month({}, "2030-01") == "2030-01"
    rows = {(r.supplier, r.sku): r for r in suppliers.recommend(both, suppliers.Assumptions(growth_by_sku={"b": 0.0}), now="2030-01").collect()}
    assert set(rows) == {(s, k) for s in ("First", "Second") for k in "ab"}
    a, b = rows["First", "a"], rows["Second", "b"]
    # 30 on the first of July less 100 sold; 100 a month over three months, in fifties.
    assert (a.current_stock, a.stock_source, a.base_demand, a.recommended_order) == (0.0, "projected_from_opening", 100.0, 300.0)
    assert (b.current_stock, b.stock_source, b.before_moq) == (3.0, "explicit_snapshot", 27.0)
    only_sales = {"monthly": files(spark)["monthly"]}
    with pytest.raises(suppliers.MissingStock):
        suppliers.load("Third", only_sales, today="2024-08-01")


def test_supplier_keys(spark):
    names = spark.createDataFrame([(1, "Ёлка и Щука"), (2, "elka i schuka"), (3, "  "), (4, "ООО «Рога-1»")], "at int, name string")
    assert [r.key for r in suppliers.supplier_keys(names, "at").orderBy(F.length("name"), "key").collect()] == ["supplier", "elka-i-schuka", "ooo-roga-1", "elka-i-schuka-2"]


def test_file_of_all_orders(spark, tmp_path):
    lines = spark.createDataFrame([("s", "b", "=B", 5.0, 6.0, "high"), ("s", "a", 'A"', 5.5, 7.5, "low"), ("r", "z", "Z", 1.0, 0.0, "low")], "supplier string, sku string, product_name string, recommended double, quantity double, urgency string")
    sinks.write_all_orders(lines, str(tmp_path / "o"))
    text = b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "o/part-*")))).decode()
    assert text.split("\r\n")[1:3] == ['"s";"a";"A""";"5.5";"7.5";"low"', '"s";"b";"\'=B";"5";"6";"high"'] and text.startswith("\ufeff")


def test_text_rules(spark):
    row = spark.range(1).select(
        F.array(*[C.plural(F.lit(n), "a", "b", "c") for n in (1, 2, 5, 11, 21, 112)]).alias("forms"),
        C.decimal_comma(F.lit(1.5)).alias("comma"),
        F.array(C.claims_cause(F.lit("This Proves it")), C.claims_cause(F.lit("it improves")), C.claims_cause(F.lit(None))).alias("cause"),
        F.array(C.display_label(F.lit("net_flow")), C.display_label(F.lit("x"), {"x": "Known"})).alias("labels"),
        C.fnv1a(F.lit("a")).alias("hash"),
        C.header_key(F.lit(" Ёмкость,  Склад_1 ")).alias("key"),
        sinks.share_urls(F.lit("a b"), "http://x/")[0].alias("url"),
        sinks.share_urls(F.lit("a b"), "http://x/")[1].alias("form"),
    ).first()
    assert row.forms == ["a", "b", "c", "c", "a", "c"] and row.comma == "1,5" and row.cause == [True, False, False]
    assert row.labels == ["Net flow", "Known"] and row.hash == "e40c292c" and row.key == "емкость склад 1"
    assert row.url.endswith("a%20b") and row.form.endswith("text=a+b")


def test_controls_are_held_to_where_they_mean_something():
    held = suppliers.Assumptions.from_controls(lead_time_months=0, review_period_months=-1, growth_percent=-200, shelf_life_percent=float("nan"), service_a=50, service_b=100, service_unclassified=97.5)
    assert (held.lead_time, held.review_period, held.growth, held.least_shelf_life) == (0.1, 0.0, -0.99, 0.0)
    assert held.service_levels == {"1": 0.9, "A": 0.9, "2": 0.995, "B": 0.995, "3": 0.9, "4": 0.9, "C": 0.9, "UNCLASSIFIED": 0.975}
    assert suppliers.Assumptions.from_controls().service_levels == suppliers.Assumptions().service_levels
    assert suppliers.Assumptions.from_controls(shelf_life_percent=150, category="A").least_shelf_life == 100.0
