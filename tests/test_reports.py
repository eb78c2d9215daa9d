"""Report sheets to relations."""

import pytest

from larkspur.sources import reports as R


def sheet(spark, *rows):
    return spark.createDataFrame([(k, [None if c is None else str(c) for c in r]) for k, r in enumerate(rows, 1)], "row int, cells array<string>")


def got(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_journal(spark):
    rows = sheet(spark, ["report"], ["Дата", "Номер", "Документ", "Код", "Номенклатура", "Количество"], ["05.02.2024 10:30", "n1", "Расход", "a", "A", "-3"], ["2024-03-01T00:00:00.000Z", "n2", None, "b", "B", "1,5"], ["31.02.2024", "n3", None, "c", "C", "1"], ["01.01.2024", "n4", "Приходная накладная 7", "d", "D", "1"], ["01.01.2024", "n5", None, "e", "E", "0"], ["01.01.2024", "n6", None, None, "E", "1"])
    made = R.transactions(rows)
    assert got(made.selectExpr("sku", "cast(occurred_at as string) t", "units_sold"), "sku", "t", "units_sold") == [("a", "2024-02-05 10:30:00", 3.0), ("b", "2024-03-01 00:00:00", 1.5)]


def test_months_in_columns(spark):
    rows = sheet(spark, ["Код", "Наименование", "Янв 2024", "март 2024"], [None, None, "Количество", "Количество"], ["a", "A", "1 000", None])
    assert got(R.monthly(rows), "sku", "month", "value") == [("a", "2024-01", 1000.0), ("a", "2024-03", 0.0)]


def test_months_in_rows(spark):
    rows = sheet(spark, ["Код", "Наименование", "Месяц", "Количество"], ["a", None, "мая 2024", 2], ["a", "A", "Май 2024", 3], ["a", "A2", "2", 5], ["b", "B", "x", 5])
    assert got(R.monthly(rows), "sku", "product_name", "month", "value") == [("a", "A", "2024-05", 5.0)]
    assert got(R.monthly(rows, 2023), "sku", "month", "value") == [("a", "2023-02", 5.0), ("a", "2024-05", 5.0)]


def test_inbound(spark):
    rows = sheet(spark, ["Код 1с", "Наименование", "Поступление до 05.03.2024", "Товар в пути"], ["a", "A", 4, 0], ["b", "B", None, 7])
    assert got(R.inbound(rows), "sku", "expected_date", "quantity") == [("a", "2024-03-05", 4.0), ("b", None, 7.0)]


def test_pairs(spark):
    rows = sheet(spark, ["Код 1с", "Наименование", "Кратность", "Зарезервировано", "Остаток", "Остаток ТЗ", "СС реал.", "Категория 2024"], ["a", "A", 5, -1, -2, 9, "3,5", "x"], ["b", "B", 0, None, 4, 9, 0, None])
    assert got(R.multiples(rows), "sku", "multiple") == [("a", 5.0)]
    assert got(R.reservations(rows), "sku", "reserved_stock") == [("a", 0.0)]
    assert got(R.current_stock(rows), "sku", "current_stock") == [("a", 0.0), ("b", 4.0)]
    assert got(R.cost_prices(rows), "sku", "cost_price") == [("a", 3.5)]
    assert got(R.categories(rows), "sku", "category") == [("a", "x")]


def test_batches(spark):
    flat = sheet(spark, ["Код", "Количество", "Склад", "ОСГ, %", "Годен"], ["a", 2, "w", "0.35", "12"], ["a", 3, None, 80, "истёк"], ["b", 0, "w", None, None])
    assert got(R.batches(flat, "2024-01-01"), "sku", "warehouse", "quantity", "shelf_life_percent", "expired") == [("a", "w", 2.0, 35.0, False), ("a", None, 3.0, 80.0, True)]
    matrix = sheet(spark, ["Код", "Срок годности", "Склад 1", "Склад 2"], ["a", "31.12.23", 1, None], ["b", "01.01.2024", 2, 3])
    assert got(R.batches(matrix, "2024-01-01"), "sku", "warehouse", "quantity", "expired") == [("a", "Склад 1", 1.0, True), ("b", "Склад 1", 2.0, False), ("b", "Склад 2", 3.0, False)]


def test_missing_columns(spark):
    with pytest.raises(R.MissingColumn):
        R.monthly(sheet(spark, ["x", "y"]))
    assert R.optional([sheet(spark, ["x"]).selectExpr("0 as sheet_no", "*")], R.multiples) is None
