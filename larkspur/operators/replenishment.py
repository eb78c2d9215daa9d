"""Replenishment planning: from sales facts to a recommended order per supplier and SKU.

Every function maps frames to a frame.  Series are keyed by (supplier, sku); all
windows and group-bys share that key, so one shuffle serves consecutive steps.
Dimensions are unique on the key and joined with plain left joins, for which
adaptive execution chooses broadcast or a split sort-merge join by measured size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import DAYS_PER_MONTH, clamp, let, month_add, z_score

KEY = ["supplier", "sku"]


@dataclass(frozen=True)
class Options:
    """Planning parameters.  The clock never enters: ``as_of`` is explicit."""

    as_of: str = "2000-12"
    lead_time: float = 2.0
    review_period: float = 1.0
    service_levels: dict[str, float] = field(default_factory=lambda: {"A": 0.98, "B": 0.95, "C": 0.9})
    default_service: float = 0.95
    trend_window: int = 3
    growth_cap: float = 0.5
    stockout_stock: float = 0.0
    stockout_neighbour: float = 1.0
    stockout_ratio: float = 0.5

    def validate(self) -> None:
        """Raises where a parameter has no meaning."""
        if self.lead_time <= 0 or self.review_period < 0 or self.trend_window < 1:
            raise ValueError("lead time must be positive, review period and window not negative")
        if any(not 0 < x < 1 for x in [*self.service_levels.values(), self.default_service]):
            raise ValueError("a service level lies between 0 and 1")


def last_wins(dim: DataFrame, order: str, keys: list[str] = KEY) -> DataFrame:
    """One row for each key: the last by ``order``, without a sort or a window."""
    rest = [c for c in dim.columns if c not in keys]
    last = dim.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in rest if c != order))


def monthly_aggregate(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "month").agg(F.sum("units_sold").alias("units_sold"))


def invoice_orders(transactions: DataFrame, as_of: str) -> DataFrame:
    """Order sizes by month and invoice; a blank invoice is an order of its own, named
    by its row's place in the series.

    ``row_order`` begins with the time, so a place is the rows of the months before
    and the place within the month: no task sorts more than a month of a series.
    """
    rows = transactions.filter(F.col("month") <= as_of)
    months = rows.groupBy(*KEY, "month").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    months = months.select(*KEY, "month", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.withColumn("_within", F.row_number().over(Window.partitionBy(*KEY, "month").orderBy("row_order")))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in [*KEY, "month"]]
    joined = placed.alias("r").join(months.alias("m"), same[0] & same[1] & same[2]).select("r.*", (F.col("m.before") + F.col("r._within")).alias("_place"))
    named = joined.withColumn("invoice", F.coalesce(F.nullif(F.trim("invoice_number"), F.lit("")), F.concat(F.lit("ROW-"), F.col("_place").cast("string"))))
    return named.groupBy(*KEY, "month", "invoice").agg(F.sum("units_sold").alias("units"))


def order_sizes(transactions: DataFrame, as_of: str) -> DataFrame:
    """supplier, sku, month, units, n: how many orders of each size a month has.

    An order is an invoice's rows of a SKU and month; a row without an invoice is an
    order of its own.  Both shuffles are on keys finer than a series and aggregate
    first, so a hot series is spread; what is left is small.
    """
    invoice = F.nullif(F.trim("invoice_number"), F.lit(""))
    rows = transactions.filter(F.col("month") <= as_of).withColumns({"_invoice": invoice, "_row": F.when(invoice.isNull(), F.col("row_order"))})
    orders = rows.groupBy(*KEY, "month", "_invoice", "_row").agg(F.sum("units_sold").alias("units"))
    return counted_sizes(orders)


def counted_sizes(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*KEY, "month", "units").agg(F.count(F.lit(1)).alias("n"))


def judged_sizes(sizes: DataFrame) -> DataFrame:
    """``sizes`` with orders (positive ones of the series), mad and threshold.

    Quartiles and the median deviation are interpolated between the values at their
    ranks, found by running counts over the sorted sizes: sorts spill, and no buffer
    holds the sizes of a series.
    """
    series_of = Window.partitionBy(*KEY)
    running = Window.unboundedPreceding, Window.currentRow
    df = sizes.withColumn("_k", F.when(F.col("units") > 0, F.col("n")).otherwise(0))
    df = df.withColumns({"orders": F.sum("_k").over(series_of), "_upto": F.sum("_k").over(series_of.orderBy("units", "month").rowsBetween(*running))})

    def at(value: str, upto: str, fraction: float) -> Column:
        place = (F.col("orders") - 1) * fraction
        low, high = (F.min(F.when((F.col("_k") > 0) & (F.col(upto) > rank), F.col(value))).over(series_of) for rank in (F.floor(place), F.ceil(place)))
        return low + (high - low) * (place - F.floor(place))

    df = df.withColumns({f"_q{k}": at("units", "_upto", k / 4) for k in (1, 2, 3)})
    df = df.withColumn("_off", F.when(F.col("_k") > 0, F.abs(F.col("units") - F.col("_q2"))))
    df = df.withColumn("_upto", F.sum("_k").over(series_of.orderBy(F.asc_nulls_last("_off"), "units", "month").rowsBetween(*running)))
    df = df.withColumn("mad", at("_off", "_upto", 0.5))
    bound = F.greatest(F.col("_q2") * 3, F.least(F.col("_q2") + F.col("mad") * (3 * 1.4826), F.col("_q3") + (F.col("_q3") - F.col("_q1")) * 1.5))
    return df.withColumn("threshold", F.when(F.col("orders") < 4, F.lit(float("inf"))).otherwise(bound)).drop("_k", "_upto", "_off", "_q1", "_q2", "_q3")


def spike_threshold(orders: DataFrame) -> DataFrame:
    """Robust bound of usual order sizes; infinite below four positive orders."""
    judged = judged_sizes(counted_sizes(orders)).filter("orders > 0")
    return judged.groupBy(*KEY).agg(F.max("orders").alias("n"), F.max("mad").alias("mad"), F.max("threshold").alias("threshold"))


def month_rows(judged: DataFrame, as_of: str) -> DataFrame:
    """One row for each series: ``m`` (its months in order, with what was sold and
    what of it stays as demand), one_off, retained and spike_units.

    A series has one entry a calendar month, so the array is bounded by the years of
    history.  Large orders in two or more recent months are growth and stay.
    """
    since = F.date_format(F.add_months(F.to_date(F.lit(f"{as_of}-01")), -2), "yyyy-MM")
    large = F.col("units") > F.col("threshold")
    months = judged.groupBy(*KEY, "month").agg(F.sum(F.col("units") * F.col("n")).alias("sold"), F.coalesce(F.sum(F.when(large, F.col("units") * F.col("n"))), F.lit(0.0)).alias("large"), F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("spikes"))
    rows = months.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("month", "sold", "large", "spikes"))).alias("_m"))
    recent = F.size(F.filter("_m", lambda x: (x["month"] >= since) & (x["spikes"] > 0))) >= 2
    rows = rows.withColumn("_m", let(recent, lambda known: F.transform("_m", lambda x: F.struct(x["month"].alias("month"), x["sold"].alias("sold"), x["large"].alias("large"), x["spikes"].alias("spikes"), (known & (x["month"] >= since)).alias("growth")))))

    def total(of: Callable[[Column], Column], zero: Column) -> Column:
        return F.aggregate("_m", zero, lambda a, x: a + of(x))

    zero = F.lit(0).cast("long")
    return rows.select(
        *KEY,
        F.transform("_m", lambda x: F.struct(x["month"].alias("month"), x["sold"].alias("sold"), F.greatest(F.lit(0.0), x["sold"] - F.when(x["growth"], 0.0).otherwise(x["large"])).alias("units"))).alias("m"),
        total(lambda x: F.when(x["growth"], zero).otherwise(x["spikes"]), zero).alias("one_off"),
        total(lambda x: F.when(x["growth"], x["spikes"]).otherwise(zero), zero).alias("retained"),
        total(lambda x: F.when(x["growth"], 0.0).otherwise(x["large"]), F.lit(0.0)).alias("spike_units"),
    )


def spike_candidates(orders: DataFrame) -> DataFrame:
    return orders.join(spike_threshold(orders).select(*KEY, "threshold"), KEY).filter("units > threshold")


def classified_spikes(orders: DataFrame, as_of: str) -> DataFrame:
    """Candidates with ``retained``: large orders in two or more recent months are growth."""
    found = spike_candidates(orders)
    since = F.date_format(F.add_months(F.to_date(F.lit(f"{as_of}-01")), -2), "yyyy-MM")
    recent = found.filter(F.col("month") >= since).groupBy(*KEY).agg(F.countDistinct("month").alias("recent_months"))
    joined = found.join(recent, KEY, "left")
    return joined.select(*KEY, "month", "invoice", "units", "threshold", (F.coalesce("recent_months", F.lit(0)) >= 2).alias("sustained"), ((F.coalesce("recent_months", F.lit(0)) >= 2) & (F.col("month") >= since)).alias("retained"))


def cleaned_demand(monthly: DataFrame, spikes: DataFrame, as_of: str) -> DataFrame:
    """Monthly sales up to ``as_of`` less the one-off orders of the month."""
    off = spikes.filter("not retained").groupBy(*KEY, "month").agg(F.sum("units").alias("off"))
    return monthly.filter(F.col("month") <= as_of).join(off, [*KEY, "month"], "left").select(*KEY, "month", F.col("units_sold").alias("sold"), F.greatest(F.lit(0.0), F.col("units_sold") - F.coalesce("off", F.lit(0.0))).alias("units"))


def series(cleaned: DataFrame, opening: DataFrame, options: Options) -> DataFrame:
    """One row for each key: its months in order, and its opening balances.

    A series has one entry a calendar month, so its array is bounded by the years
    of history; everything after this step is row-wise and needs no shuffle.
    ``rows`` holds month, sold, units, opening_stock and stockout: no opening stock
    while demand fell below that of both neighbouring rows.
    """
    last = opening.groupBy(*KEY, "month").agg(F.max_by("opening_stock", "row_order").alias("opening_stock"))
    stocks = last.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("month", "opening_stock"))).alias("stocks"))
    months = cleaned.join(last, [*KEY, "month"], "left").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("month", "sold", "units", "opening_stock"))).alias("m"))

    return with_stockouts(months.join(stocks, KEY, "left"), options)


def with_stockouts(series: DataFrame, options: Options) -> DataFrame:
    """``rows`` from ``m`` (month, sold, units and opening_stock in order); row-wise."""

    def row(m: Column, x: Column, i: Column) -> Column:
        before, after = F.get(m, i - 1)["units"], F.get(m, i + 1)["units"]
        short = (x["opening_stock"] <= options.stockout_stock) & (before >= options.stockout_neighbour) & (after >= options.stockout_neighbour) & (x["units"] < (before + after) / 2 * options.stockout_ratio)
        return F.struct(x["month"].alias("month"), x["sold"].alias("sold"), x["units"].alias("units"), x["opening_stock"].alias("opening_stock"), F.coalesce(short, F.lit(False)).alias("stockout"))

    return series.withColumn("rows", let(F.col("m"), lambda m: F.transform(m, lambda x, i: row(m, x, i)))).drop("m")


def _mean(values: Column) -> Column:
    """Mean of an array of doubles; null of an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _units(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["units"])


#: Arrays of a series are bound with ``let`` where lambdas use them: the optimiser
#: may merge projections, and a lambda then evaluates what it names for each item.
def _of_month(rows: Column, moy: Column) -> Column:
    return _mean(_units(F.filter(rows, lambda x: F.substring(x["month"], 6, 2) == moy)))


def demand_stats(found: DataFrame) -> DataFrame:
    """Base and raw demand, deviation, demand pattern, lifecycle inputs and trend inputs."""
    df = found.withColumn("kept", F.filter("rows", lambda x: ~x["stockout"]))
    df = df.withColumns({"base_demand": F.coalesce(_mean(_units(F.col("kept"))), F.lit(0.0)), "raw_demand": _mean(_units(F.col("rows"))), "n": F.size("kept"), "months": F.size("rows")})
    squares = let(F.col("base_demand"), lambda base: F.transform("kept", lambda x: (x["units"] - base) * (x["units"] - base)))
    df = df.withColumns({"demand_std": F.sqrt(F.coalesce(_mean(squares), F.lit(0.0))), "nonzero_share": F.coalesce(_mean(F.transform("kept", lambda x: (x["units"] > 0).cast("double"))), F.lit(0.0)), "stockout_months": F.col("months") - F.col("n")})
    cv = F.when(F.col("base_demand") > 0, F.try_divide("demand_std", "base_demand")).otherwise(0.0)
    return df.withColumn("demand_pattern", F.when(F.col("nonzero_share") <= 0.5, "intermittent").when(cv >= 0.75, "volatile").otherwise("stable"))


def lifecycle(stats: DataFrame) -> DataFrame:
    """active, slow or dead, from the last three rows against earlier ones."""
    n = F.col("n")
    df = stats.withColumns({"recent": F.slice("kept", F.greatest(n - 2, F.lit(1)), 3), "past": F.slice("kept", 1, F.greatest(n - 3, F.lit(0)))})
    bases = let(F.col("past"), lambda past: F.filter(F.transform("recent", lambda r: let(F.substring(r["month"], 6, 2), lambda moy: _of_month(past, moy))), lambda x: x.isNotNull()))
    df = df.withColumns({"recent_avg": _mean(_units(F.col("recent"))), "bases": bases})
    enough = F.size("bases") >= 2
    earlier = F.when(n >= 12, F.when(enough, _mean(F.col("bases"))).otherwise(0.0)).otherwise(F.coalesce(_mean(_units(F.col("past"))), F.lit(0.0)))
    df = df.withColumn("earlier", earlier)
    judged = ((n < 12) | enough) & (F.size("recent") == 3) & (F.col("earlier") >= 1)
    status = F.when(judged & (F.col("recent_avg") <= F.col("earlier") * 0.1), "dead").when(judged & (F.col("recent_avg") <= F.col("earlier") * 0.35), "slow").otherwise("active")
    return df.withColumn("lifecycle", status).drop("recent", "past", "bases")


def trend(stats: DataFrame, window: int) -> DataFrame:
    """Mean of the last ``window`` kept rows and of the ``window`` before them."""
    n, start = F.col("n"), F.greatest(F.col("n") - window + 1, F.lit(1))
    recent = F.slice("kept", start, window)
    first = F.greatest(n - 2 * window + 1, F.lit(1))
    earlier = F.slice("kept", first, F.greatest(start - first, F.lit(0)))
    return stats.withColumns({"recent_mean": _mean(_units(recent)), "earlier_mean": F.coalesce(_mean(_units(earlier)), F.lit(0.0))})


def planning(found: DataFrame, config: DataFrame | None, options: Options) -> DataFrame:
    """Demand, lifecycle, horizon, growth and season of each configured series.

    Here and below a dimension is None where the series holds its columns already.
    """
    joined = trend(lifecycle(demand_stats(found)), options.trend_window)
    joined = joined if config is None else joined.join(config, KEY)
    out = joined.withColumn("lead_time", F.coalesce("lead_time_months", F.lit(options.lead_time)))
    out = out.withColumns(
        {
            "planning_demand": F.when(F.col("lifecycle") == "dead", 0.0).when(F.col("lifecycle") == "slow", F.col("recent_avg")).otherwise(F.col("base_demand")),
            "horizon": F.col("lead_time") + options.review_period,
            "raw_growth": F.when((F.col("lifecycle") != "active") | (F.col("demand_pattern") == "intermittent") | (F.col("earlier_mean") <= 0), 0.0).otherwise(F.try_divide("recent_mean", "earlier_mean") - 1),
        }
    )
    growth = clamp(F.col("raw_growth"), -options.growth_cap, options.growth_cap)
    out = out.withColumns({"historical_growth": growth, "growth_factor": (1 + growth) * (1 + F.col("forecast_growth_rate")), "stockout_factor": F.when(F.col("raw_demand") > 0, F.greatest(F.lit(1.0), F.col("base_demand") / F.col("raw_demand"))).otherwise(1.0)})
    return out.withColumn("forecast", seasonal_forecast(options))


def seasonal_forecast(options: Options) -> Column:
    """Array of step, month, index and weight over the months of the horizon."""
    seasonal = (F.col("lifecycle") == "active") & (F.col("demand_pattern") != "intermittent") & (F.col("base_demand") > 0)

    def ahead(known: Column, step: Column) -> Column:
        month = month_add(F.lit(options.as_of), step + 1)
        usual = let(F.substring(month, 6, 2), lambda moy: _of_month(known["kept"], moy))
        index = F.coalesce(F.when(known["seasonal"], F.try_divide(usual, known["base"])), F.lit(1.0))
        return F.struct(step.alias("step"), month.alias("month"), index.alias("index"), F.least(F.lit(1.0), known["horizon"] - step).alias("weight"))

    all_of = F.struct(F.col("kept").alias("kept"), F.col("base_demand").alias("base"), F.col("horizon").alias("horizon"), seasonal.alias("seasonal"))
    return let(all_of, lambda known: F.transform(F.sequence(F.lit(0), F.ceil(known["horizon"]).cast("int") - 1), lambda step: ahead(known, step)))


def seasonal_index(forecast: Column) -> Column:
    total = F.aggregate(forecast, F.lit(0.0), lambda a, x: a + x["index"] * x["weight"])
    return F.coalesce(F.try_divide(total, F.aggregate(forecast, F.lit(0.0), lambda a, x: a + x["weight"])), F.lit(1.0))


def current_stock(found: DataFrame, snapshot: DataFrame | None, as_of: str) -> DataFrame:
    """An explicit snapshot, else the latest opening balance rolled forward by net sales."""
    latest = F.try_element_at(F.filter("stocks", lambda x: x["month"] <= as_of), F.lit(-1))
    df = found.withColumns({"opening_month": latest["month"], "opening": latest["opening_stock"]})
    sold = let(F.col("opening_month"), lambda first: F.aggregate(F.filter("rows", lambda x: x["month"] >= first), F.lit(0.0), lambda a, x: a + x["sold"]))
    df = df.withColumn("sold_since", F.greatest(F.lit(0.0), F.coalesce(sold, F.lit(0.0))))
    joined = df if snapshot is None else df.join(last_wins(snapshot, "row_order"), KEY, "left")
    rolled_on = F.greatest(F.lit(0.0), F.coalesce("opening", F.lit(0.0)) - F.col("sold_since"))
    return joined.select(*[c for c in df.columns if c not in ("opening", "current_stock", "excluded_for_shelf_life")], F.coalesce("opening", F.lit(0.0)).alias("opening"), F.coalesce("current_stock", rolled_on).alias("current_stock"), F.when(F.col("current_stock").isNotNull(), "explicit_snapshot").otherwise("projected_from_opening").alias("stock_source"), F.coalesce("excluded_for_shelf_life", F.lit(0.0)).alias("expiring_excluded"))


def inbound_split(inbound: DataFrame, config: DataFrame | None, options: Options) -> DataFrame:
    """Goods in transit within the horizon (past dates count), of unknown date and after it."""
    end = F.last_day(F.add_months(F.to_date(F.lit(f"{options.as_of}-01")), F.ceil("horizon").cast("int")))
    begin = F.add_months(F.to_date(F.lit(f"{options.as_of}-01")), 1)
    horizon = F.coalesce("lead_time_months", F.lit(options.lead_time)) + options.review_period
    rows = inbound.withColumn("horizon", horizon) if config is None else inbound.join(config.select(*KEY, horizon.alias("horizon")), KEY)
    eta = F.col("expected_date")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("quantity"))), F.lit(0.0))

    return rows.groupBy(*KEY).agg(total(eta <= end).alias("inbound_within"), total(eta.isNull()).alias("inbound_unknown"), total(eta > end).alias("inbound_after"), F.min(F.when(eta >= begin, eta)).alias("nearest_inbound"))


def _spike_counts(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy(*KEY).agg(F.count_if(~F.col("retained")).alias("one_off"), F.count_if("retained").alias("retained"), F.coalesce(F.sum(F.when(~F.col("retained"), F.col("units"))), F.lit(0.0)).alias("spike_units"))


def recommend(plan: DataFrame, inbound: DataFrame, reserved: DataFrame | None, multiples: DataFrame | None, spikes: DataFrame | None, options: Options) -> DataFrame:
    """The recommendation of each planned series with its stock, unrounded.

    ``inbound`` is the result of ``inbound_split``.
    """
    df = plan.withColumn("seasonal_index", seasonal_index(F.col("forecast"))).join(inbound, KEY, "left")
    for dimension in (reserved, multiples):
        df = df if dimension is None else df.join(last_wins(dimension, "row_order"), KEY, "left")
    if spikes is not None:
        df = df.join(_spike_counts(spikes), KEY, "left")
    df = df.fillna(0.0, ["inbound_within", "inbound_unknown", "inbound_after", "reserved_stock", "spike_units"]).fillna(0, ["one_off", "retained"])
    level = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in options.service_levels.items()], F.lit(options.default_service))
    dead = F.col("lifecycle") == "dead"
    df = df.withColumns({"z": z_score(level), "adjusted_rate": F.col("planning_demand") * F.col("seasonal_index") * F.col("growth_factor"), "available": F.greatest(F.lit(0.0), F.col("current_stock") - F.col("reserved_stock"))})
    df = df.withColumn("safety_stock", F.when(dead, 0.0).otherwise(F.col("z") * F.col("demand_std") * F.sqrt("horizon")))
    df = df.withColumns({"target_position": F.col("adjusted_rate") * F.col("horizon") + F.col("safety_stock"), "current_position": F.col("available") + F.col("inbound_within")})
    df = df.withColumn("before_moq", F.when(dead, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target_position") - F.col("current_position"))))
    moves = F.col("adjusted_rate") > 0
    df = df.withColumns(
        {
            "recommended_order": F.when((F.col("multiple") > 0) & (F.col("before_moq") > 0), F.ceil(F.try_divide("before_moq", "multiple")).cast("double") * F.col("multiple")).otherwise(F.col("before_moq")),
            "coverage_months": F.when(moves, F.try_divide("current_position", "adjusted_rate")),
            "days_of_supply": F.when(moves, F.try_divide("available", "adjusted_rate") * DAYS_PER_MONTH),
        }
    )
    begin = F.add_months(F.to_date(F.lit(f"{options.as_of}-01")), 1)
    surplus = F.coalesce(F.col("coverage_months") > F.col("horizon") * 2, F.lit(False))
    df = df.withColumns({"overstock": surplus, "overstock_months": F.when(surplus, F.col("coverage_months") - F.col("horizon")).otherwise(0.0), "stockout_date": F.date_add(begin, F.least(F.ceil("days_of_supply"), F.lit(2_000_000)).cast("int"))})
    df = df.withColumns(
        {
            "gap_days": F.greatest(F.lit(0), F.datediff("nearest_inbound", "stockout_date")),
            "urgency": F.when(F.col("coverage_months") < F.col("lead_time"), "high").when(F.col("coverage_months") < F.col("horizon"), "medium").otherwise("low"),
            "spike_order_impact": F.col("spike_units") / F.greatest(F.lit(1), F.col("months")) * F.col("horizon"),
        }
    )
    df = df.withColumn("gap_days", F.when(F.col("nearest_inbound").isNotNull() & F.col("stockout_date").isNotNull(), F.col("gap_days")))
    return df.withColumn("exceptions", exceptions())


def exceptions():
    """Codes in their fixed order."""
    rules = (
        ("stockout", F.col("stockout_months") > 0),
        ("one_off_spike", F.col("one_off") > 0),
        ("sustained_growth_signal", F.col("retained") > 0),
        ("unknown_eta", F.col("inbound_unknown") > 0),
        ("inbound_after_horizon", F.col("inbound_after") > 0),
        ("surplus", F.col("overstock")),
        ("slow_stock", F.col("lifecycle") == "slow"),
        ("dead_stock", F.col("lifecycle") == "dead"),
        ("expiring_stock", F.col("expiring_excluded") > 0),
    )
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


EXCEPTIONS = ("stockout", "one_off_spike", "sustained_growth_signal", "unknown_eta", "inbound_after_horizon", "surplus", "slow_stock", "dead_stock", "expiring_stock")
URGENCY, LIFECYCLE, PATTERNS = ("high", "medium", "low"), ("active", "slow", "dead"), ("stable", "volatile", "intermittent")


def zero_filled_counts(plan: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """Counts of a column's values with zeros for absent keys."""
    names = plan.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return names.join(plan.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").fillna(0, ["n"])


def order_deadlines(plan: DataFrame, today: str) -> DataFrame:
    """Needed orders with the day they must go out and its bucket."""
    day = F.date_sub("stockout_date", F.round(F.col("lead_time") * DAYS_PER_MONTH).cast("int"))
    needed = plan.filter("recommended_order > 0").withColumn("order_by", day)
    bucket = F.when(F.col("order_by").isNull(), "unknown").when(F.col("order_by") < F.lit(today).cast("date"), "overdue").otherwise(F.date_format("order_by", "yyyy-MM"))
    return needed.withColumn("bucket", bucket)


def exception_views(plan: DataFrame, views: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each view that an item belongs to: urgent ones, and those by code."""
    codes = [F.when(F.arrays_overlap("exceptions", F.array(*map(F.lit, held))), F.lit(view)) for view, held in views.items() if held]
    return plan.withColumn("view", F.explode(F.array_compact(F.array(F.when(F.col("urgency") == "high", F.lit("urgent")), *codes))))


def with_names(plan: DataFrame, transactions: DataFrame) -> DataFrame:
    """``product_name``: that of the last sales row, else the SKU."""
    names = last_wins(transactions.select(*KEY, "product_name", "row_order"), "row_order")
    return plan.join(names, KEY, "left").withColumn("product_name", F.coalesce("product_name", "sku"))


def order_messages(orders: DataFrame, as_of: str, lines: int) -> DataFrame:
    """supplier and message: the first lines of its order by SKU, the rest counted.

    ``orders`` has supplier, sku, product_name and quantity.  The lines that are shown
    are picked by a partial top; totals come from the same aggregation.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    whole = F.col("quantity") == F.floor("quantity")
    amount = lambda c: F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    item = F.struct(F.col("sku").alias("order"), F.concat(plain("sku"), F.lit(" — "), F.when(whole, F.col("quantity").cast("bigint").cast("string")).otherwise(F.col("quantity").cast("string")), F.lit(" шт. · "), plain("product_name")).alias("text"))
    place = F.row_number().over(Window.partitionBy("supplier").orderBy("sku"))
    ranked = orders.filter("quantity > 0").withColumns({"_line": place, "_item": item})
    shown = F.sort_array(F.collect_list(F.when(F.col("_line") <= lines, F.struct("_line", "_item.text"))))
    made = ranked.groupBy("supplier").agg(F.transform(shown, lambda x: F.concat(x["_line"].cast("string"), F.lit(". "), x["text"])).alias("details"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("total"))
    more = F.when(F.col("n") > lines, F.concat(F.lit("…ещё "), (F.col("n") - lines).cast("string"), F.lit(" поз. — полный перечень в приложенном CSV.")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Заказ поставщику "), "supplier"),
        F.lit(f"Расчёт на {as_of}"),
        F.lit(""),
        F.array_join("details", "\n"),
        more,
        F.lit(""),
        F.concat(F.lit("Итого: "), F.col("n").cast("string"), F.lit(" поз., "), amount(F.col("total")), F.lit(" шт.")),
        F.lit("Количество подтверждено менеджером. Просьба подтвердить наличие и срок поставки."),
    )
    return made.select("supplier", text.alias("message"))


def manager_quantity(quantity, multiple):
    """Not negative, rounded up to the order multiple."""
    q = F.greatest(F.lit(0.0), quantity)
    return F.when((multiple > 0) & (q > 0), F.ceil(F.try_divide(q, multiple)).cast("double") * multiple).otherwise(q)


def batch_stock(batches: DataFrame, least_percent: float) -> DataFrame:
    """Usable and excluded stock of each SKU, and usable stock by warehouse."""
    good = (~F.coalesce("expired", F.lit(False))) & (F.col("shelf_life_percent").isNull() | (F.col("shelf_life_percent") >= least_percent))
    places = batches.groupBy(*KEY, "warehouse").agg(F.sum(F.when(good, F.col("quantity"))).alias("valid"), F.sum(F.when(~good, F.col("quantity"))).alias("off"))
    named = F.filter(F.collect_list(F.struct("warehouse", "valid")), lambda x: x["warehouse"].isNotNull() & x["valid"].isNotNull())
    return places.groupBy(*KEY).agg(F.coalesce(F.sum("valid"), F.lit(0.0)).alias("current_stock"), F.coalesce(F.sum("off"), F.lit(0.0)).alias("excluded_for_shelf_life"), F.map_from_entries(named).alias("stock_by_warehouse"))


def batch_over_snapshot(from_batches: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Batch-derived stock where there is any, snapshots for the other SKUs."""
    return from_batches.select(*KEY, "current_stock").unionByName(snapshot.join(from_batches, KEY, "left_anti").select(*KEY, "current_stock"))


def scoped_lookup(config: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of each configured series; unscoped ones only where no scoped fact exists.

    ``facts`` may hold rows without a supplier.  The scoped key wins as a whole.
    """
    scoped = config.select(*KEY).join(facts.filter("supplier is not null"), KEY)
    bare = config.select(*KEY).join(scoped.select(*KEY).distinct(), KEY, "left_anti")
    return scoped.unionByName(bare.join(facts.filter("supplier is null").drop("supplier"), "sku"))
