"""From the files of suppliers to the inputs of a plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import identity, replenishment
from larkspur.sources import reports

#: What the files of a supplier may be.
KINDS = ("transactions", "monthly", "opening", "inbound", "multiples", "batches", "categories", "reservations", "stock")


class MissingStock(ValueError):
    """A supplier without opening balances, stock or batches."""


@dataclass(frozen=True)
class Assumptions:
    """What stands for values that no file gives."""

    lead_time: float = 2.0
    review_period: float = 1.0
    category: str = "B"
    growth: float = 0.0
    least_shelf_life: float = 30.0
    lead_time_by_sku: Mapping[str, float] = field(default_factory=dict)
    growth_by_sku: Mapping[str, float] = field(default_factory=dict)
    service_levels: Mapping[str, float] = field(default_factory=lambda: {"1": 0.98, "2": 0.95, "3": 0.9, "4": 0.9, "A": 0.98, "B": 0.95, "C": 0.9, "UNCLASSIFIED": 0.95})

    @classmethod
    def from_controls(cls, *, lead_time_months: float = 2.0, review_period_months: float = 1.0, growth_percent: float = 0.0, shelf_life_percent: float = 30.0, service_a: float = 98.0, service_b: float = 95.0, service_c: float = 90.0, service_unclassified: float = 95.0, **more) -> Assumptions:
        """Assumptions from what a planner has set, each held to where it has a meaning.

        A lead time is 0.1 months at least, a review period not negative, growth above
        -99 percent, shelf life from 0 to 100 percent, and 0 where it is no number, and
        service levels from 90 to 99.5 percent.
        """
        level = lambda percent: min(99.5, max(90.0, percent)) / 100
        shelf = min(100.0, max(0.0, shelf_life_percent)) if math.isfinite(shelf_life_percent) else 0.0
        a, b, c = level(service_a), level(service_b), level(service_c)
        levels = {"1": a, "A": a, "2": b, "B": b, "3": c, "4": c, "C": c, "UNCLASSIFIED": level(service_unclassified)}
        return cls(max(0.1, lead_time_months), max(0.0, review_period_months), growth=max(-99.0, growth_percent) / 100, least_shelf_life=shelf, service_levels=levels, **more)


def _union(frames: Sequence[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def _parsed(supplier: str, kind: str, books: Sequence[DataFrame], parse: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    found = []
    for number, book in enumerate(books, 1):
        try:
            found.append(reports.first_sheet(book, parse).withColumn("file_rank", F.lit(number)))
        except reports.MissingColumn as missing:
            raise reports.MissingColumn(f"supplier {supplier}, {kind}, file {number}: {missing}") from missing
    return _union(found)


def _monthly(year: int | None) -> Callable[[DataFrame], DataFrame]:
    """Plain months, else the hierarchical report, whose rows may lack a SKU."""

    def parse(rows: DataFrame) -> DataFrame:
        try:
            return reports.monthly(rows, year)
        except reports.MissingColumn:
            return reports.grouped(rows).withColumnRenamed("units", "value").drop("row")

    return parse


def load(supplier: str, files: Mapping[str, Sequence[DataFrame]], *, today: str, year: int | None = None) -> dict[str, DataFrame]:
    """Relations of one supplier from its workbooks (rows of ``workbook.scan`` for each
    file, by kind), each with a column ``supplier``.

    Sales without a SKU take it from the names of the other files; ``unmatched`` holds
    the names that found none.  Raises if there is no kind of stock at all.
    """
    of = lambda kind: list(files.get(kind, ()))
    out: dict[str, DataFrame | None] = {"transactions": _parsed(supplier, "transactions", of("transactions"), reports.transactions)}
    sales = _parsed(supplier, "monthly", of("monthly"), _monthly(year))
    balances, from_balances = [], []
    for number, book in enumerate(of("opening"), 1):
        try:
            balances.append(reports.first_sheet(book, lambda rows: reports.monthly(rows, year)).withColumn("file_rank", F.lit(number)))
        except reports.MissingColumn:
            from_balances.append(reports.first_sheet(book, lambda rows: reports.batches(rows, today)))
    opening = _union(balances)
    if opening is not None:
        opening = opening.groupBy("sku", "month").agg(F.sum("value").alias("opening_stock"), F.min_by("product_name", "file_rank").alias("product_name"), F.max("file_rank").alias("row_order"))
    out["opening"] = opening
    out["inbound"] = _parsed(supplier, "inbound", of("inbound"), reports.inbound)
    out["multiples"] = _parsed(supplier, "multiples", of("multiples"), reports.multiples)
    more = _parsed(supplier, "batches", of("batches"), lambda rows: reports.batches(rows, today))
    out["batches"] = _union([x for x in (*from_balances, more) if x is not None])
    for kind, parse in (("categories", reports.categories), ("reservations", reports.reservations), ("stock", reports.current_stock)):
        out[kind] = reports.optional(of(kind), parse)
    if out["opening"] is None and out["stock"] is None and out["batches"] is None:
        raise MissingStock(f"supplier {supplier} has no file with stock")
    if sales is not None:
        names = [x.select("sku", "product_name") for x in (out["transactions"], opening, out["inbound"], out["multiples"], out["batches"]) if x is not None and "product_name" in x.columns]
        known = _union(names)
        if known is None:
            known = sales.select("sku", "product_name").limit(0)
        resolved = identity.reconcile(sales.withColumn("place", F.monotonically_increasing_id()), known.filter("coalesce(sku, '') <> ''"))
        out["unmatched"] = identity.unmatched(resolved, "place")
        booked = resolved.filter("resolved is not null").drop("sku").withColumnRenamed("resolved", "sku")
        out["monthly"] = booked.groupBy("sku", "month").agg(F.sum("value").alias("units_sold"), F.min_by("product_name", "place").alias("product_name"))
    return {kind: df.withColumn("supplier", F.lit(supplier.strip())) for kind, df in out.items() if df is not None}


def union(suppliers: Sequence[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """The relations of all suppliers by kind; a kind that one lacks is that of the others."""
    kinds = {kind for one in suppliers for kind in one}
    return {kind: _union([one[kind] for one in suppliers if kind in one]) for kind in sorted(kinds)}


def as_of_month(relations: Mapping[str, DataFrame], now: str) -> str:
    """The last month with an opening balance over all suppliers, else ``now``."""
    if "opening" not in relations:
        return now
    return relations["opening"].agg(F.max("month")).first()[0] or now


def plan_inputs(relations: Mapping[str, DataFrame], assume: Assumptions) -> dict[str, DataFrame]:
    """config and snapshot of the series that are sold: assumptions fill what is missing,
    and stock from batches goes before a plain snapshot."""
    series = relations["monthly"].select("supplier", "sku").distinct()
    if "categories" in relations:
        series = series.join(replenishment.last_wins(relations["categories"].select("supplier", "sku", "category", "file_rank"), "file_rank"), replenishment.KEY, "left")
    else:
        series = series.withColumn("category", F.lit(None).cast("string"))

    def by_sku(values: Mapping[str, float], default: Column) -> Column:
        if not values:
            return default
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), F.col("sku")), default)

    config = series.select(*replenishment.KEY, F.coalesce("category", F.lit(assume.category)).alias("category"), by_sku(assume.growth_by_sku, F.lit(assume.growth)).alias("forecast_growth_rate"), by_sku(assume.lead_time_by_sku, F.lit(None).cast("double")).alias("lead_time_months"))
    parts = []
    derived = replenishment.batch_stock(relations["batches"], assume.least_shelf_life).withColumn("row_order", F.lit(1)) if "batches" in relations else None
    if derived is not None:
        parts.append(derived.select(*replenishment.KEY, "current_stock", "excluded_for_shelf_life", "row_order"))
    if "stock" in relations:
        plain = relations["stock"].select(*replenishment.KEY, "current_stock", F.lit(0.0).alias("excluded_for_shelf_life"), F.col("file_rank").alias("row_order"))
        parts.append(plain if derived is None else plain.join(derived, replenishment.KEY, "left_anti"))
    found = {"config": config}
    snapshot = _union(parts)
    return found | ({"snapshot": snapshot} if snapshot is not None else {})


def recommend(relations: Mapping[str, DataFrame], assume: Assumptions, *, now: str) -> DataFrame:
    """The recommendation of every series of the suppliers' files."""
    as_of = as_of_month(relations, now)
    options = replenishment.Options(as_of=as_of, lead_time=assume.lead_time, review_period=assume.review_period, service_levels=dict(assume.service_levels), default_service=assume.service_levels.get("UNCLASSIFIED", 0.95))
    spark = relations["monthly"].sparkSession
    made = plan_inputs(relations, assume)
    empty = lambda schema: spark.createDataFrame([], schema)
    key = "supplier string, sku string, "
    sales = relations.get("transactions")
    sales = empty(key + "month string, invoice_number string, units_sold double, row_order long") if sales is None else sales.withColumns({"month": F.date_format("occurred_at", "yyyy-MM"), "row_order": F.struct("occurred_at", "file_rank", "row")})
    spikes = replenishment.classified_spikes(replenishment.invoice_orders(sales, as_of), as_of)
    cleaned = replenishment.cleaned_demand(relations["monthly"], spikes, as_of)
    opening = relations.get("opening", empty(key + "month string, opening_stock double, row_order int"))
    series = replenishment.series(cleaned, opening, options)
    stock = replenishment.current_stock(series, made.get("snapshot", empty(key + "current_stock double, excluded_for_shelf_life double, row_order int")), as_of)
    inbound = relations.get("inbound", empty(key + "expected_date date, quantity double"))
    dims = {"reservations": ("reserved_stock", empty(key + "reserved_stock double, row_order int")), "multiples": ("multiple", empty(key + "multiple double, row_order int"))}
    reserved, multiples = (relations[kind].select("supplier", "sku", column, F.col("file_rank").alias("row_order")) if kind in relations else none for kind, (column, none) in dims.items())
    planned = replenishment.planning(stock, made["config"], options)
    return replenishment.recommend(planned, replenishment.inbound_split(inbound, made["config"], options), reserved, multiples, spikes, options)


#: Cyrillic letters and the Latin ones that stand for them.
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}


def supplier_keys(names: DataFrame, order: str) -> DataFrame:
    """name and key: Latin letters and digits joined by dashes; names with the same key
    get -2, -3 and so on in their order."""
    letters = F.create_map(*[F.lit(x) for item in LATIN.items() for x in item])
    chars = F.split(F.lower(F.trim("name")), "")
    base = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")
    plain = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-|-$", "")
    keyed = names.withColumn("base", F.coalesce(F.nullif(plain, F.lit("")), F.lit("supplier")))
    place = F.row_number().over(Window.partitionBy("base").orderBy(order))
    return keyed.withColumn("k", place).select("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string"))).alias("key"))
