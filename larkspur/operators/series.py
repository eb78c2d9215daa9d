"""Precursors in a series: which signals moved before the anchor.

A series is a wide table with a running number.  Findings, anchor and edges are frames of
one plan: one aggregate over the rows finds what stands out, one join lays the anchor
beside all signals at every lag, and one aggregate a lag holds what correlations need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import clamp
from larkspur.operators import inference

#: Lags tried, edges kept, pairs that a correlation and an interval need,
#: pairs that are enough, and the normal quantile of the interval.
MOST_LAG, EDGES, LEAST_PAIRS, ENOUGH, QUANTILE = 3, 5, 5, 30, 1.959963985


def findings(wide: DataFrame, signals: list[str], idx: str = "idx") -> DataFrame:
    """rank, signal, n, latest, mean, deviation, z of the signals whose latest value lies a
    deviation or more from their mean; the farthest first, then in the order of columns."""
    facts = []
    for place, c in enumerate(signals):
        x = F.col(c).cast("double")
        facts.append(F.struct(F.lit(place).alias("place"), F.lit(c).alias("signal"), F.count(x).alias("n"), F.max_by(x, F.when(x.isNotNull(), F.col(idx))).alias("latest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation")))
    rows = wide.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    z = F.when(F.col("deviation") > 0, (F.col("latest") - F.col("mean")) / F.col("deviation")).otherwise(0.0)
    kept = rows.withColumn("z", z).filter((F.col("n") >= 3) & (F.abs("z") >= 1))
    # As many rows as there are signals.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.abs("z"), 9)), "place")
    return kept.withColumn("rank", F.row_number().over(order)).select("rank", "signal", "n", "latest", "mean", "deviation", "z")


def anchor_of(found: DataFrame, signals: list[str], target: str | None = None) -> DataFrame:
    """anchor: the target, if it is a signal, else the first finding; one row."""
    first = F.min_by("signal", "rank")
    return found.agg((F.lit(target) if target in signals else first).alias("anchor"))


def lags(wide: DataFrame, signals: list[str], found: DataFrame, target: str | None = None, idx: str = "idx") -> DataFrame:
    """signal, anchor, lag, n, r of every finding but the anchor at all lags.

    A lag is tried up to a quarter of the rows, and up to the first with too few pairs.
    """
    anchor = anchor_of(found, signals, target)
    length = wide.agg(F.least(F.lit(MOST_LAG), F.floor(F.count(F.lit(1)) / 4)).cast("int").alias("most"))
    by_name = F.create_map(*[x for c in signals for x in (F.lit(c), F.col(c).cast("double"))])
    later = wide.select(F.col(idx).alias("_at"), by_name.alias("_of")).crossJoin(F.broadcast(anchor)).select("_at", "anchor", F.try_element_at("_of", "anchor").alias("_y"))
    moved = wide.crossJoin(F.broadcast(length)).withColumn("lag", F.explode(F.sequence(F.lit(0), "most"))).withColumn("_at", F.col(idx) + F.col("lag"))
    pairs = moved.join(later, "_at")

    def pair(c: str) -> Column:
        x, y = F.col(c).cast("double"), F.col("_y")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        r = F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))
        return F.struct(F.lit(c).alias("signal"), F.count(x).alias("n"), r.alias("r"))

    made = pairs.groupBy("anchor", "lag").agg(F.array(*[pair(c) for c in signals]).alias("e")).select("anchor", F.col("lag").cast("bigint").alias("lag"), F.explode("e").alias("e")).select("e.signal", "anchor", "lag", "e.n", "e.r")
    candidates = made.join(found.select("signal"), "signal", "left_semi").filter("signal <> anchor")
    short = F.min(F.when(F.col("n") < LEAST_PAIRS, F.col("lag"))).over(Window.partitionBy("signal"))
    return candidates.withColumn("_short", short).filter("_short is null or lag < _short").drop("_short")


def edges(lagged: DataFrame) -> DataFrame:
    """signal, anchor, lag, n, r, low, high: the five strongest signals, each at its
    strongest lag, the smallest of equals, with Fisher's interval from six pairs on."""
    keep = [c for c in lagged.columns if c not in ("signal", "anchor")]
    best = lagged.groupBy("signal", "anchor").agg(F.max_by(F.struct(*keep), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("b")).select("signal", "anchor", "b.*")
    chosen = best.orderBy(F.desc(F.round(F.abs("r"), 9)), "signal").limit(EDGES)
    r = clamp(F.col("r"), -0.999999, 0.999999)
    z, reach = F.log((1 + r) / (1 - r)) * 0.5, F.lit(QUANTILE) / F.sqrt(F.col("n") - 3)
    enough = F.col("n") >= inference.LEAST_PAIRS
    return chosen.withColumns({"low": F.when(enough, F.tanh(z - reach)), "high": F.when(enough, F.tanh(z + reach))})


def risk(chosen: DataFrame) -> DataFrame:
    """risk and label: the mean strength of the edges, less where pairs are few; 0 without edges."""
    value = F.when(F.count("r") > 0, clamp(F.avg(F.abs("r")) * clamp(F.min("n") / ENOUGH, 0.0, 1.0), 0.0, 1.0)).otherwise(0.0)
    return chosen.agg(value.alias("risk")).withColumn("label", F.when(F.col("risk") < 0.33, "LOW").when(F.col("risk") < 0.66, "MEDIUM").otherwise("HIGH"))


def pairs_of(wide: DataFrame, signals: list[str], chosen: DataFrame, idx: str = "idx") -> DataFrame:
    """signal, lag, idx, x, y: the pairs of the chosen edges, by one join of the long series."""
    long = wide.select(idx, F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("x")) for c in signals])).alias("e")).select(F.col(idx).alias("idx"), "e.signal", "e.x").filter("x is not null")
    first = long.join(F.broadcast(chosen.select("signal", "anchor", "lag")), "signal").withColumn("_at", F.col("idx") + F.col("lag"))
    later = long.select(F.col("idx").alias("_at"), F.col("signal").alias("anchor"), F.col("x").alias("y"))
    return first.join(later, ["_at", "anchor"]).select("signal", "lag", "idx", "x", "y")


def chain(wide: DataFrame, signals: list[str], target: str | None = None, idx: str = "idx") -> DataFrame:
    """The edges with p-values, Holm's verdict over each signal's lags, and their stability
    under moving blocks."""
    lagged = lags(wide, signals, findings(wide, signals, idx), target, idx)
    tested = inference.holm(lagged.withColumn("p", inference.p_value(F.col("r"), F.col("n"))), ["signal"])
    chosen = edges(tested)
    seed = F.concat("signal", F.lit("->"), "anchor", F.lit(":"), F.col("n").cast("string"))
    seeded = pairs_of(wide, signals, chosen, idx).join(F.broadcast(chosen.select("signal", seed.alias("seed"))), "signal")
    stable = inference.bootstrap(seeded, F.col("seed")).select("signal", "median", F.col("low").alias("stable_low"), F.col("high").alias("stable_high"), "resamples", "stability")
    return chosen.join(stable, "signal", "left")
