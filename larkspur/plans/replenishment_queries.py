"""Queries over the replenishment plan, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import rounded
from larkspur.operators import replenishment as R
from larkspur.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = "2001-02-01"


@dataclass
class Plan:
    """The steps of one plan; a query builds only the steps that it names."""

    spark: SparkSession
    sf_dir: str
    grain: str = "p_type"
    filled: bool = False
    options: R.Options = R.Options(as_of=V.AS_OF)

    @cached_property
    def transactions(self) -> DataFrame:
        return V.transactions(self.spark, self.sf_dir, self.grain)

    @cached_property
    def monthly(self) -> DataFrame:
        return V.monthly(self.spark, self.sf_dir, self.grain, self.filled)

    @cached_property
    def skus(self) -> DataFrame:
        return V.series(self.spark, self.sf_dir, self.grain)

    @cached_property
    def opening(self) -> DataFrame:
        return V.opening(self.monthly)

    @cached_property
    def orders(self) -> DataFrame:
        return R.invoice_orders(self.transactions, self.options.as_of)

    @cached_property
    def spikes(self) -> DataFrame:
        return R.classified_spikes(self.orders, self.options.as_of)

    @cached_property
    def cleaned(self) -> DataFrame:
        return R.cleaned_demand(self.monthly, self.spikes, self.options.as_of)

    @cached_property
    def judged(self) -> DataFrame:
        """Order sizes of each series and month, from one scan of the facts."""
        past = self.transactions.filter(F.col("occurred_at") < F.lit(V.AFTER).cast("timestamp_ntz"))
        return R.judged_sizes(R.order_sizes(past, self.options.as_of))

    @cached_property
    def series(self) -> DataFrame:
        """One row for each series, with its dimensions; all later steps are row-wise."""
        months = V.with_opening(R.month_rows(self.judged, self.options.as_of), self.filled)
        return V.with_dimensions(R.with_stockouts(months, self.options))

    @cached_property
    def flagged(self) -> DataFrame:
        return self.series.select("supplier", "sku", F.inline("rows"))

    @cached_property
    def plan(self) -> DataFrame:
        return R.planning(self.series, None, self.options)

    @cached_property
    def forecast(self) -> DataFrame:
        """A horizon has a month at least, so the outer form gives the same rows; for the inner
        one the optimiser infers a filter and pushes it, with all steps of the plan written out
        in it, below the projections."""
        return self.plan.select("supplier", "sku", F.inline_outer("forecast"))

    @cached_property
    def stock(self) -> DataFrame:
        return R.current_stock(self.series, None, self.options.as_of)

    @cached_property
    def inbound(self) -> DataFrame:
        return V.inbound(self.spark, self.sf_dir, self.grain)

    @cached_property
    def recommended(self) -> DataFrame:
        arrivals = R.inbound_split(V.with_dimensions(self.inbound), None, self.options)
        return R.recommend(R.planning(self.stock, None, self.options), arrivals, None, None, None, self.options)


_CHAIN = """
upto AS (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY l_shipdate, l_orderkey, l_linenumber, units_sold, l_partkey) AS rn FROM tx WHERE month <= '{asof}'),
inv AS (SELECT supplier, sku, month, coalesce(nullif(trim(invoice_number), ''), 'ROW-' || rn) AS invoice, sum(units_sold) AS units FROM upto GROUP BY ALL),
centre AS (SELECT supplier, sku, count(*) AS n, quantile_cont(units, CAST(0.25 AS DOUBLE)) AS q1, median(units) AS q2, quantile_cont(units, CAST(0.75 AS DOUBLE)) AS q3 FROM inv WHERE units > 0 GROUP BY ALL),
spread AS (SELECT c.supplier, c.sku, n, q1, q2, q3, median(abs(units - q2)) AS mad FROM inv JOIN centre c USING (supplier, sku) WHERE units > 0 GROUP BY ALL),
bound AS (SELECT supplier, sku, n, mad, CASE WHEN n < 4 THEN CAST('inf' AS DOUBLE) ELSE greatest(q2 * 3, least(q2 + mad * CAST(4.4478 AS DOUBLE), q3 + (q3 - q1) * CAST(1.5 AS DOUBLE))) END AS threshold FROM spread),
cand AS (SELECT inv.*, threshold FROM inv JOIN bound USING (supplier, sku) WHERE units > threshold),
rec_m AS (SELECT supplier, sku, count(DISTINCT month) AS k FROM cand WHERE month >= '{since}' GROUP BY ALL),
spikes AS (SELECT cand.*, coalesce(k, 0) >= 2 AS sustained, coalesce(k, 0) >= 2 AND month >= '{since}' AS retained FROM cand LEFT JOIN rec_m USING (supplier, sku)),
off AS (SELECT supplier, sku, month, sum(units) AS off FROM spikes WHERE NOT retained GROUP BY ALL),
cleaned AS (SELECT m.supplier, m.sku, m.month, units_sold AS sold, greatest(0, units_sold - coalesce(off, 0)) AS units FROM monthly m LEFT JOIN off USING (supplier, sku, month) WHERE month <= '{asof}'),
around AS (SELECT c.*, opening_stock, lag(units) OVER w AS b, lead(units) OVER w AS a FROM cleaned c LEFT JOIN opening USING (supplier, sku, month) WINDOW w AS (PARTITION BY supplier, sku ORDER BY month)),
flagged AS (SELECT supplier, sku, month, sold, units, opening_stock, coalesce(opening_stock <= 0 AND b >= 1 AND a >= 1 AND units < (b + a) / 2 * CAST(0.5 AS DOUBLE), false) AS stockout FROM around),
stats0 AS (SELECT supplier, sku, coalesce(avg(units) FILTER (NOT stockout), 0) AS base_demand, avg(units) AS raw_demand, coalesce(stddev_pop(units) FILTER (NOT stockout), 0) AS demand_std,
  coalesce(avg(CASE WHEN units > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT stockout), 0) AS nonzero_share, count(*) FILTER (stockout) AS stockout_months, count(*) AS months FROM flagged GROUP BY ALL),
stats AS (SELECT *, CASE WHEN nonzero_share <= 0.5 THEN 'intermittent' WHEN base_demand > 0 AND demand_std / base_demand >= 0.75 THEN 'volatile' ELSE 'stable' END AS demand_pattern FROM stats0),
ranked AS (SELECT *, substr(month, 6, 2) AS moy, row_number() OVER (PARTITION BY supplier, sku ORDER BY month DESC) AS rn FROM flagged WHERE NOT stockout),
life0 AS (SELECT supplier, sku, count(*) AS n, count(*) FILTER (rn <= 3) AS n_recent, avg(units) FILTER (rn <= 3) AS recent_avg, coalesce(avg(units) FILTER (rn > 3), 0) AS earlier_avg,
  avg(units) FILTER (rn <= 3) AS recent_mean, coalesce(avg(units) FILTER (rn > 3 AND rn <= 6), 0) AS earlier_mean FROM ranked GROUP BY ALL),
usual AS (SELECT supplier, sku, moy, avg(units) AS usual FROM ranked WHERE rn > 3 GROUP BY ALL),
cal AS (SELECT supplier, sku, count(*) AS n_base, avg(usual) AS calendar_avg FROM ranked JOIN usual USING (supplier, sku, moy) WHERE rn <= 3 GROUP BY ALL),
life1 AS (SELECT l.*, coalesce(n_base, 0) AS n_base, CASE WHEN n >= 12 THEN CASE WHEN coalesce(n_base, 0) >= 2 THEN calendar_avg ELSE 0 END ELSE earlier_avg END AS earlier FROM life0 l LEFT JOIN cal USING (supplier, sku)),
life AS (SELECT *, CASE WHEN NOT ((n < 12 OR n_base >= 2) AND n_recent = 3 AND earlier >= 1) THEN 'active' WHEN recent_avg <= earlier * CAST(0.1 AS DOUBLE) THEN 'dead' WHEN recent_avg <= earlier * CAST(0.35 AS DOUBLE) THEN 'slow' ELSE 'active' END AS lifecycle FROM life1),
plan0 AS (SELECT stats.*, coalesce(lifecycle, 'active') AS lifecycle, recent_avg, recent_mean, earlier_mean, c.category, c.forecast_growth_rate, coalesce(c.lead_time_months, 2) AS lead_time, coalesce(c.lead_time_months, 2) + 1 AS horizon
  FROM stats LEFT JOIN life USING (supplier, sku) JOIN config c USING (supplier, sku)),
plan1 AS (SELECT *, CASE lifecycle WHEN 'dead' THEN 0 WHEN 'slow' THEN recent_avg ELSE base_demand END AS planning_demand,
  greatest(-0.5, least(0.5, CASE WHEN lifecycle <> 'active' OR demand_pattern = 'intermittent' OR coalesce(earlier_mean, 0) <= 0 THEN 0 ELSE recent_mean / earlier_mean - 1 END)) AS historical_growth FROM plan0),
plan AS (SELECT *, (1 + historical_growth) * (1 + forecast_growth_rate) AS growth_factor, CASE WHEN raw_demand > 0 THEN greatest(1, base_demand / raw_demand) ELSE 1 END AS stockout_factor FROM plan1),
months_usual AS (SELECT supplier, sku, substr(month, 6, 2) AS moy, avg(units) AS usual FROM flagged WHERE NOT stockout GROUP BY ALL),
steps AS (SELECT *, unnest(range(CAST(ceil(horizon) AS INTEGER))) AS step FROM plan),
steps2 AS (SELECT *, strftime(TIMESTAMP '{asof}-01' + to_months(CAST(step + 1 AS INTEGER)), '%Y-%m') AS fmonth FROM steps),
forecast AS (SELECT p.supplier, p.sku, p.step, p.fmonth AS month, CASE WHEN lifecycle = 'active' AND demand_pattern <> 'intermittent' AND base_demand > 0 AND usual IS NOT NULL THEN usual / base_demand ELSE 1 END AS "index", least(1, horizon - step) AS weight
  FROM steps2 p LEFT JOIN months_usual u ON p.supplier = u.supplier AND p.sku = u.sku AND substr(p.fmonth, 6, 2) = u.moy),
seasonal AS (SELECT supplier, sku, sum("index" * weight) / sum(weight) AS seasonal_index FROM forecast GROUP BY ALL),
latest AS (SELECT supplier, sku, max(month) AS opening_month, arg_max(opening_stock, month) AS opening FROM opening WHERE month <= '{asof}' GROUP BY ALL),
rolled AS (SELECT m.supplier, m.sku, max(opening_month) AS opening_month, max(opening) AS opening, greatest(0, coalesce(sum(units_sold) FILTER (month >= opening_month), 0)) AS sold_since FROM monthly m LEFT JOIN latest USING (supplier, sku) WHERE month <= '{asof}' GROUP BY ALL),
stock AS (SELECT r.supplier, r.sku, opening_month, coalesce(opening, 0) AS opening, sold_since, coalesce(current_stock, greatest(0, coalesce(opening, 0) - sold_since)) AS current_stock,
  CASE WHEN current_stock IS NULL THEN 'projected_from_opening' ELSE 'explicit_snapshot' END AS stock_source, coalesce(excluded, 0) AS expiring_excluded FROM rolled r LEFT JOIN snapshot USING (supplier, sku)),
transit AS (SELECT p.supplier, p.sku, sum(CASE WHEN eta <= last_day(DATE '{asof}-01' + to_months(CAST(ceil(horizon) AS INTEGER))) THEN quantity ELSE 0 END) AS inbound_within, sum(CASE WHEN eta IS NULL THEN quantity ELSE 0 END) AS inbound_unknown,
  sum(CASE WHEN eta > last_day(DATE '{asof}-01' + to_months(CAST(ceil(horizon) AS INTEGER))) THEN quantity ELSE 0 END) AS inbound_after, min(eta) FILTER (eta >= DATE '2001-01-01') AS nearest_inbound FROM inbound i JOIN plan p USING (supplier, sku) GROUP BY ALL),
spiked AS (SELECT supplier, sku, count(*) FILTER (NOT retained) AS one_off, count(*) FILTER (retained) AS retained, coalesce(sum(units) FILTER (NOT retained), 0) AS spike_units FROM spikes GROUP BY ALL),
r0 AS (SELECT p.*, coalesce(seasonal_index, 1) AS seasonal_index, current_stock, stock_source, expiring_excluded, coalesce(inbound_within, 0) AS inbound_within, coalesce(inbound_unknown, 0) AS inbound_unknown, coalesce(inbound_after, 0) AS inbound_after, nearest_inbound,
  coalesce(reserved_stock, 0) AS reserved_stock, multiple, coalesce(one_off, 0) AS one_off, coalesce(retained, 0) AS retained, coalesce(spike_units, 0) AS spike_units,
  CAST(CASE category WHEN 'A' THEN 2.0537 WHEN 'B' THEN 1.6449 ELSE 1.2816 END AS DOUBLE) AS z
  FROM plan p LEFT JOIN seasonal USING (supplier, sku) LEFT JOIN stock USING (supplier, sku) LEFT JOIN transit USING (supplier, sku) LEFT JOIN reserved USING (supplier, sku) LEFT JOIN multiples USING (supplier, sku) LEFT JOIN spiked USING (supplier, sku)),
r1 AS (SELECT *, planning_demand * seasonal_index * growth_factor AS adjusted_rate, greatest(0, current_stock - reserved_stock) AS available, CASE lifecycle WHEN 'dead' THEN 0 ELSE z * demand_std * sqrt(horizon) END AS safety_stock FROM r0),
r2 AS (SELECT *, adjusted_rate * horizon + safety_stock AS target_position, available + inbound_within AS current_position FROM r1),
r3 AS (SELECT *, CASE lifecycle WHEN 'dead' THEN 0 ELSE greatest(0, target_position - current_position) END AS before_moq FROM r2),
r4 AS (SELECT *, CASE WHEN multiple > 0 AND before_moq > 0 THEN ceil(before_moq / multiple) * multiple ELSE before_moq END AS recommended_order, CASE WHEN adjusted_rate > 0 THEN current_position / adjusted_rate END AS coverage_months,
  CASE WHEN adjusted_rate > 0 THEN available / adjusted_rate * CAST(30.4375 AS DOUBLE) END AS days_of_supply FROM r3),
r5 AS (SELECT *, coalesce(coverage_months > horizon * 2, false) AS overstock, CASE WHEN coverage_months > horizon * 2 THEN coverage_months - horizon ELSE 0 END AS overstock_months,
  DATE '2001-01-01' + CAST(least(ceil(days_of_supply), 2000000) AS INTEGER) AS stockout_date FROM r4),
rec AS (SELECT *, greatest(0, date_diff('day', stockout_date, nearest_inbound)) AS gap_days0, CASE WHEN coverage_months < lead_time THEN 'high' WHEN coverage_months < horizon THEN 'medium' ELSE 'low' END AS urgency, spike_units / greatest(1, months) * horizon AS spike_order_impact,
  list_filter([CASE WHEN stockout_months > 0 THEN 'stockout' END, CASE WHEN one_off > 0 THEN 'one_off_spike' END, CASE WHEN retained > 0 THEN 'sustained_growth_signal' END, CASE WHEN inbound_unknown > 0 THEN 'unknown_eta' END, CASE WHEN inbound_after > 0 THEN 'inbound_after_horizon' END,
    CASE WHEN overstock THEN 'surplus' END, CASE WHEN lifecycle = 'slow' THEN 'slow_stock' END, CASE WHEN lifecycle = 'dead' THEN 'dead_stock' END, CASE WHEN expiring_excluded > 0 THEN 'expiring_stock' END], lambda x: x IS NOT NULL) AS exceptions FROM r5)
""".format(asof=V.AS_OF, since="2000-10")


def _sql(select: str, grain: str = "p_type", filled: bool = False) -> str:
    return f"WITH {V.facts_sql(grain, filled)},{_CHAIN}{select}"


def _query(name: str, step: str, columns: dict[str, str], sql_from: str, where: str = "", sparse: bool = False, **sql_columns: str) -> None:
    """Register one step: output column -> expression, equal in both dialects unless overridden."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan(spark, sf_dir, *(("p_brand", True) if sparse else ()))
        df = getattr(plan, step)
        df = df.filter(where) if where else df
        return df.select(*[F.expr(e).alias(c) for c, e in columns.items()])

    QUERIES[name] = run
    SQL[name] = _sql("SELECT " + ", ".join(f"{sql_columns.get(c, e)} AS {c}" for c, e in columns.items()) + f" FROM {sql_from}" + (f" WHERE {where}" if where else ""), *(("p_brand", True) if sparse else ()))


_K = {"supplier": "supplier", "sku": "sku"}
_r = lambda *names: {n: f"round({n}, 6)" for n in names}
_n = lambda *names: {n: f"cast({n} as bigint)" for n in names}

_query("monthly_aggregate", "monthly", _K | {"month": "month"} | _r("units_sold"), "monthly")
_query("asof_filter", "monthly", _K | {"month": "month"} | _r("units_sold"), "monthly", where=f"month <= '{V.AS_OF}'")
_query("invoice_aggregate", "orders", _K | {"month": "month", "invoice": "invoice"} | _r("units"), "inv")
QUERIES["spike_threshold"] = lambda spark, d: R.spike_threshold(Plan(spark, d).orders).select("supplier", "sku", F.col("n").cast("bigint").alias("n"), F.round("mad", 6).alias("mad"), F.round("threshold", 6).alias("threshold"))
SQL["spike_threshold"] = _sql("SELECT supplier, sku, CAST(n AS BIGINT) AS n, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM bound")
_query("spike_candidates", "spikes", _K | {"month": "month", "invoice": "invoice"} | _r("units", "threshold"), "spikes")
_query("sustained_growth", "spikes", _K | {"month": "month", "invoice": "invoice", "sustained": "sustained", "retained": "retained"} | _r("units"), "spikes")
_query("cleaned_demand", "cleaned", _K | {"month": "month"} | _r("sold", "units"), "cleaned")
_query("stockout_months", "flagged", _K | {"month": "month"} | _r("units"), "flagged", where="stockout")
_query("stockout_neighbors", "flagged", _K | {"month": "month"} | _r("units", "opening_stock") | {"stockout": "stockout"}, "flagged", sparse=True)
_query("base_demand", "plan", _K | _r("base_demand", "raw_demand", "demand_std") | _n("stockout_months", "months"), "plan")
_query("demand_pattern", "plan", _K | _r("nonzero_share") | {"demand_pattern": "demand_pattern"}, "plan", sparse=True)
_query("lifecycle", "plan", _K | _r("recent_avg") | {"lifecycle": "lifecycle"}, "plan", sparse=True)
_query("planning_demand", "plan", _K | _r("planning_demand"), "plan")
_query("horizon", "plan", _K | _r("lead_time", "horizon"), "plan")
_query("recent_vs_earlier", "plan", _K | _r("recent_mean", "earlier_mean"), "plan")
_query("historical_growth", "plan", _K | _r("historical_growth"), "plan")
_query("growth_factor", "plan", _K | _r("growth_factor"), "plan")
_query("stockout_factor", "plan", _K | _r("stockout_factor"), "plan")
_query("seasonal_forecast", "forecast", _K | {"month": "month", "season_index": "round(index, 6)"} | _r("weight") | _n("step"), "forecast", season_index='round("index", 6)')
#: An index is a quotient of means and may be a tie in its decimal text only.
QUERIES["seasonal_forecast"] = lambda spark, d: Plan(spark, d).forecast.select(*_K, "month", rounded(F.col("index"), 6).alias("season_index"), rounded(F.col("weight"), 6).alias("weight"), F.col("step").cast("bigint").alias("step"))
_query("seasonal_index", "recommended", _K | _r("seasonal_index"), "rec")
_query("adjusted_rate", "recommended", _K | _r("adjusted_rate"), "rec")
_query("latest_opening_asof", "stock", _K | {"opening_month": "opening_month"} | _r("opening", "sold_since"), "stock")
_query("current_stock", "stock", _K | _r("current_stock", "expiring_excluded") | {"stock_source": "stock_source"}, "stock")
_query("null_sum_nonnegative", "stock", _K | _r("sold_since"), "stock", sparse=True)
_query("available", "recommended", _K | _r("available", "reserved_stock"), "rec")
_query("inbound_split", "recommended", _K | _r("inbound_within", "inbound_unknown", "inbound_after"), "rec")
_query("nearest_inbound", "recommended", _K | {"nearest_inbound": "nearest_inbound"}, "rec")
_query("z_score_table", "recommended", _K | {"category": "category"} | _r("z"), "rec")
_query("safety_stock", "recommended", _K | _r("safety_stock"), "rec")
_query("target_position", "recommended", _K | _r("target_position", "current_position"), "rec")
_query("recommended_order", "recommended", _K | _r("before_moq", "recommended_order") | {"urgency": "urgency"}, "rec")
_query("moq_round", "recommended", _K | _r("multiple", "recommended_order"), "rec", where="multiple is not null")
_query("coverage", "recommended", _K | _r("coverage_months"), "rec")
_query("days_of_supply", "recommended", _K | _r("days_of_supply"), "rec")
_query("overstock", "recommended", _K | {"overstock": "overstock"} | _r("overstock_months"), "rec")
_query("stockout_date", "recommended", _K | {"stockout_date": "stockout_date"}, "rec")
_query("gap_days", "recommended", _K | _n("gap_days"), "rec", gap_days="CASE WHEN nearest_inbound IS NOT NULL AND stockout_date IS NOT NULL THEN CAST(gap_days0 AS BIGINT) END")
_query("urgency", "recommended", _K | {"urgency": "urgency"}, "rec")
_query("exceptions", "recommended", _K | {"exceptions": "array_join(exceptions, ',')"}, "rec", exceptions="array_to_string(exceptions, ',')")
_query("spike_order_impact", "recommended", _K | _r("spike_order_impact"), "rec")
_query("recommended_positive", "recommended", _K | _r("recommended_order"), "rec", where="recommended_order > 0")


def _rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan(spark, sf_dir).recommended


def _counts(name: str, column: str, keys: tuple[str, ...]) -> None:
    QUERIES[name] = lambda spark, d: R.zero_filled_counts(_rec(spark, d), column, keys).select(column, F.col("n").cast("bigint").alias("n"))
    listed = ", ".join(f"('{k}')" for k in keys)
    SQL[name] = _sql(f"SELECT k AS {column}, CAST(count(rec.supplier) AS BIGINT) AS n FROM (VALUES {listed}) t(k) LEFT JOIN rec ON {column} = k GROUP BY k")


_counts("plan_summary_urgency", "urgency", R.URGENCY)
_counts("plan_summary_lifecycle", "lifecycle", R.LIFECYCLE)
_counts("plan_summary_pattern", "demand_pattern", R.PATTERNS)
QUERIES["plan_summary_exceptions"] = lambda spark, d: R.zero_filled_counts(_rec(spark, d).select(F.explode("exceptions").alias("exception")), "exception", R.EXCEPTIONS).select("exception", F.col("n").cast("bigint").alias("n"))
SQL["plan_summary_exceptions"] = _sql("SELECT k AS exception, CAST(count(e) AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{k}')" for k in R.EXCEPTIONS) + ") t(k) LEFT JOIN (SELECT unnest(exceptions) AS e FROM rec) ON e = k GROUP BY k")
QUERIES["supplier_group"] = lambda spark, d: _rec(spark, d).groupBy("supplier").agg(F.count(F.lit(1)).cast("bigint").alias("sku_count"), F.round(F.sum("recommended_order"), 4).alias("units"), F.array_join(F.array_sort(F.collect_list("sku")), ",").alias("skus"))
SQL["supplier_group"] = _sql("SELECT supplier, CAST(count(*) AS BIGINT) AS sku_count, round(sum(recommended_order), 4) AS units, string_agg(sku, ',' ORDER BY sku) AS skus FROM rec GROUP BY supplier")
QUERIES["visible_group_totals"] = lambda spark, d: _rec(spark, d).filter("urgency <> 'low'").groupBy("supplier").agg(F.round(F.sum("recommended_order"), 4).alias("units"))
SQL["visible_group_totals"] = _sql("SELECT supplier, round(sum(recommended_order), 4) AS units FROM rec WHERE urgency <> 'low' GROUP BY supplier")
QUERIES["deadline_buckets"] = lambda spark, d: R.order_deadlines(_rec(spark, d), TODAY).groupBy("bucket").agg(F.count(F.lit(1)).cast("bigint").alias("items"), F.round(F.sum("recommended_order"), 4).alias("units"))
SQL["deadline_buckets"] = _sql(f"""SELECT CASE WHEN o IS NULL THEN 'unknown' WHEN o < DATE '{TODAY}' THEN 'overdue' ELSE strftime(o, '%Y-%m') END AS bucket, CAST(count(*) AS BIGINT) AS items, round(sum(recommended_order), 4) AS units
FROM (SELECT *, stockout_date - CAST(round(lead_time * CAST(30.4375 AS DOUBLE)) AS INTEGER) AS o FROM rec WHERE recommended_order > 0) GROUP BY 1""")

_RANK = "CASE urgency WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
QUERIES["today_top8"] = lambda spark, d: _rec(spark, d).filter("recommended_order > 0").orderBy(F.expr(_RANK), F.coalesce("stockout_date", F.lit("9999-12-31").cast("date")), "supplier", "sku").limit(8).select("supplier", "sku", "urgency", "stockout_date")
SQL["today_top8"] = _sql(f"SELECT supplier, sku, urgency, stockout_date FROM rec WHERE recommended_order > 0 ORDER BY {_RANK}, coalesce(stockout_date, DATE '9999-12-31'), supplier, sku LIMIT 8")
QUERIES["visible_sort"] = lambda spark, d: _rec(spark, d).select("supplier", "sku", F.expr(f"cast({_RANK} as bigint)").alias("rank"), F.round("recommended_order", 6).alias("recommended_order")).orderBy("rank", F.desc("recommended_order"))
SQL["visible_sort"] = _sql(f"SELECT supplier, sku, CAST({_RANK} AS BIGINT) AS rank, round(recommended_order, 6) AS recommended_order FROM rec ORDER BY 3, 4 DESC")
#: The views of a plan beside that of all, and the codes that they hold.
VIEWS = {"urgent": (), "anomaly": ("stockout", "one_off_spike", "sustained_growth_signal", "slow_stock", "dead_stock"), "supply": ("unknown_eta", "inbound_after_horizon"), "surplus": ("surplus",)}
QUERIES["exception_view_filter"] = lambda spark, d: R.exception_views(_rec(spark, d), VIEWS).select("supplier", "sku", "view")
SQL["exception_view_filter"] = _sql("SELECT supplier, sku, unnest(list_filter([CASE WHEN urgency = 'high' THEN 'urgent' END, " + ", ".join(f"CASE WHEN list_has_any(exceptions, {list(codes)}) THEN '{view}' END" for view, codes in VIEWS.items() if codes) + "], lambda x: x IS NOT NULL)) AS view FROM rec")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan with product names: that of the last sales row, else the SKU."""
    plan = Plan(spark, sf_dir)
    past = plan.transactions.filter(F.col("month") <= V.AS_OF).filter("length(trim(product_name)) > 0")
    return R.with_names(plan.recommended, past)


_NAMES = f"names AS (SELECT supplier, sku, arg_max(product_name, rn) AS product_name FROM upto WHERE trim(product_name) <> '' GROUP BY ALL), named AS (SELECT rec.*, coalesce(product_name, rec.sku) AS product_name FROM rec LEFT JOIN names USING (supplier, sku))"
QUERIES["product_name"] = lambda spark, d: _named(spark, d).select("supplier", "sku", "product_name")
SQL["product_name"] = _sql(f", {_NAMES} SELECT supplier, sku, product_name FROM named")
QUERIES["text_search_filter"] = lambda spark, d: _named(spark, d).filter(F.contains(F.lower(F.concat_ws(" ", "sku", "product_name", "supplier")), F.lit("al"))).select("supplier", "sku", F.round("recommended_order", 6).alias("recommended_order"))
SQL["text_search_filter"] = _sql(f", {_NAMES} SELECT supplier, sku, round(recommended_order, 6) AS recommended_order FROM named WHERE contains(lower(concat_ws(' ', sku, product_name, supplier)), 'al')")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").filter("p_size > 25").groupBy(F.col("p_type").alias("sku")).agg(F.round(F.max("p_retailprice"), 2).alias("price"))


_PRICES = "prices AS (SELECT p_type AS sku, round(max(p_retailprice), 2) AS price FROM part WHERE p_size > 25 GROUP BY 1)"
QUERIES["price_join"] = lambda spark, d: _rec(spark, d).join(_prices(spark, d), "sku").select("supplier", "sku", F.round(F.col("recommended_order") * F.col("price"), 4).alias("value"))
SQL["price_join"] = _sql("SELECT supplier, sku, round(recommended_order * price, 4) AS value FROM rec JOIN prices USING (sku)").replace("WITH ", f"WITH {_PRICES}, ", 1)
QUERIES["price_coverage"] = lambda spark, d: _rec(spark, d).join(_prices(spark, d), "sku", "left").agg(F.count("price").cast("bigint").alias("priced"), F.count(F.lit(1)).cast("bigint").alias("total"))
SQL["price_coverage"] = _sql("SELECT CAST(count(price) AS BIGINT) AS priced, CAST(count(*) AS BIGINT) AS total FROM rec LEFT JOIN prices USING (sku)").replace("WITH ", f"WITH {_PRICES}, ", 1)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed manager quantities: even suppliers raise the order by 10 units."""
    rec = _named(spark, sf_dir)
    decisions = V.series(spark, sf_dir).filter("cast(supplier as int) % 2 = 0").select("supplier", "sku", F.lit(10.0).alias("extra"))
    return rec.join(decisions, ["supplier", "sku"]).select("supplier", "sku", "product_name", R.manager_quantity(F.col("recommended_order") + F.col("extra"), F.col("multiple")).alias("quantity")).filter("quantity > 0")


_DECIDED = f"{_NAMES}, decided AS (SELECT supplier, sku, product_name, CASE WHEN multiple > 0 THEN ceil((recommended_order + 10) / multiple) * multiple ELSE recommended_order + 10 END AS quantity FROM named WHERE CAST(supplier AS INTEGER) % 2 = 0)"
QUERIES["decision_join"] = lambda spark, d: _decided(spark, d).select("supplier", "sku", F.round("quantity", 6).alias("quantity"))
SQL["decision_join"] = _sql(f", {_DECIDED} SELECT supplier, sku, round(quantity, 6) AS quantity FROM decided WHERE quantity > 0")
QUERIES["confirmed_orders_group"] = lambda spark, d: _decided(spark, d).groupBy("supplier").agg(F.count(F.lit(1)).cast("bigint").alias("lines"), F.round(F.sum("quantity"), 4).alias("total"))
SQL["confirmed_orders_group"] = _sql(f", {_DECIDED} SELECT supplier, CAST(count(*) AS BIGINT) AS lines, round(sum(quantity), 4) AS total FROM decided WHERE quantity > 0 GROUP BY supplier")


#: Lines of a message before the rest is only counted.
LINES = 4
QUERIES["order_message_lines"] = lambda spark, d: R.order_messages(_decided(spark, d), V.AS_OF, LINES)
SQL["order_message_lines"] = _sql(f""", {_DECIDED}, lines AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY sku) AS line FROM decided WHERE quantity > 0),
m AS (SELECT supplier, string_agg(line || '. ' || trim(regexp_replace(sku, '\\s+', ' ', 'g')) || ' — ' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' шт. · ' || trim(regexp_replace(product_name, '\\s+', ' ', 'g')), chr(10) ORDER BY line) FILTER (line <= {LINES}) AS details, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS total FROM lines GROUP BY supplier)
SELECT supplier, 'Заказ поставщику ' || supplier || chr(10) || 'Расчёт на {V.AS_OF}' || chr(10) || chr(10) || details || CASE WHEN n > {LINES} THEN chr(10) || '…ещё ' || (n - {LINES}) || ' поз. — полный перечень в приложенном CSV.' ELSE '' END || chr(10) || chr(10) || 'Итого: ' || n || ' поз., ' || total || ' шт.' || chr(10) || 'Количество подтверждено менеджером. Просьба подтвердить наличие и срок поставки.' AS message FROM m""")

_BATCH = """batches AS (SELECT CAST(l_suppkey AS VARCHAR) AS supplier, p_type AS sku, CASE WHEN l_linenumber = 6 THEN NULL ELSE n_name END AS warehouse, l_quantity AS quantity, round(l_discount * 1000, 3) AS pct, l_returnflag = 'R' AS expired
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), ok AS (SELECT *, NOT expired AND pct >= 30 AS good FROM batches)"""
QUERIES["batch_validity"] = lambda spark, d: V.batches(spark, d).groupBy("supplier", "sku").agg(F.count_if((~F.col("expired")) & (F.col("shelf_life_percent") >= 30)).cast("bigint").alias("valid_batches"))
SQL["batch_validity"] = f"WITH {_BATCH} SELECT supplier, sku, CAST(count(*) FILTER (good) AS BIGINT) AS valid_batches FROM ok GROUP BY ALL"
QUERIES["batch_aggregate"] = lambda spark, d: R.batch_stock(V.batches(spark, d), 30.0).select("supplier", "sku", F.round("current_stock", 6).alias("current_stock"), F.round("excluded_for_shelf_life", 6).alias("excluded"), F.size("stock_by_warehouse").cast("bigint").alias("warehouses"))
SQL["batch_aggregate"] = f"WITH {_BATCH} SELECT supplier, sku, round(coalesce(sum(quantity) FILTER (good), 0), 6) AS current_stock, round(coalesce(sum(quantity) FILTER (NOT good), 0), 6) AS excluded, CAST(count(DISTINCT warehouse) FILTER (good) AS BIGINT) AS warehouses FROM ok GROUP BY ALL"
QUERIES["batch_over_snapshot"] = lambda spark, d: R.batch_over_snapshot(R.batch_stock(V.batches(spark, d).filter("shelf_life_percent > 90"), 30.0), V.snapshot(V.series(spark, d))).select("supplier", "sku", F.round("current_stock", 6).alias("current_stock"))
SQL["batch_over_snapshot"] = f"WITH {V.facts_sql()}, {_BATCH}, b AS (SELECT supplier, sku, coalesce(sum(quantity) FILTER (good), 0) AS current_stock FROM ok WHERE pct > 90 GROUP BY ALL) SELECT supplier, sku, round(current_stock, 6) AS current_stock FROM (SELECT * FROM b UNION ALL SELECT supplier, sku, current_stock FROM snapshot s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.supplier = s.supplier AND b.sku = s.sku))"
QUERIES["batch_over_snapshot_all"] = lambda spark, d: R.batch_over_snapshot(R.batch_stock(V.batches(spark, d), 30.0), V.snapshot(V.series(spark, d))).select("supplier", "sku", F.round("current_stock", 6).alias("current_stock"))
SQL["batch_over_snapshot_all"] = f"WITH {V.facts_sql()}, {_BATCH}, b AS (SELECT supplier, sku, coalesce(sum(quantity) FILTER (good), 0) AS current_stock FROM ok GROUP BY ALL) SELECT supplier, sku, round(current_stock, 6) AS current_stock FROM (SELECT * FROM b UNION ALL SELECT supplier, sku, current_stock FROM snapshot s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.supplier = s.supplier AND b.sku = s.sku))"
QUERIES["last_wins_dim"] = lambda spark, d: R.last_wins(V.transactions(spark, d).select("supplier", "sku", "units_sold", "row_order"), "row_order").select("supplier", "sku", F.round("units_sold", 6).alias("units_sold"))
SQL["last_wins_dim"] = f"WITH {V.facts_sql()} SELECT supplier, sku, round(units_sold, 6) AS units_sold FROM (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, units_sold DESC, l_partkey DESC) AS n FROM tx) WHERE n = 1"


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of odd suppliers lose their supplier, so the fallback is used."""
    facts = V.monthly(spark, sf_dir).withColumn("supplier", F.when(F.col("supplier").cast("int") % 5 == 0, F.col("supplier")))
    unscoped = facts.filter("supplier is null").groupBy("supplier", "sku", "month").agg(F.sum("units_sold").alias("units_sold"))
    return R.scoped_lookup(V.series(spark, sf_dir), facts.filter("supplier is not null").unionByName(unscoped)).groupBy("supplier", "sku").agg(F.round(F.sum("units_sold"), 4).alias("units"))


QUERIES["scoped_lookup_left"] = _scoped
SQL["scoped_lookup_left"] = f"""WITH {V.facts_sql()}, bare AS (SELECT sku, sum(units_sold) AS u FROM monthly WHERE s % 5 <> 0 GROUP BY 1)
SELECT k.supplier, k.sku, round(coalesce(own.u, bare.u), 4) AS units FROM skus k LEFT JOIN (SELECT supplier, sku, sum(units_sold) AS u FROM monthly WHERE s % 5 = 0 GROUP BY ALL) own USING (supplier, sku) LEFT JOIN bare ON bare.sku = k.sku WHERE coalesce(own.u, bare.u) IS NOT NULL"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended order of every supplier and SKU."""
    return QUERIES["recommended_order"](spark, sf_dir)
