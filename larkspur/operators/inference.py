"""Significance of correlations: p-values, Holm's correction, block bootstrap.

These run over edges (signal, lag), a few dozen rows; only the bootstrap sees
the pairs of an edge, which a series bounds by its length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST_PAIRS, RESAMPLES = 6, 400
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(80)


def two_tailed(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """p of a correlation r over n pairs; NaN below six pairs.

    With sin a = |r|, p is the share of cos^(n-3) that lies beyond a on [0, pi/2],
    integrated by Gauss-Legendre up to where it has fallen by e^-40.
    """
    out = np.full(len(r), np.nan)
    for k, (x, pairs) in enumerate(zip(r, n)):
        if not (pairs >= LEAST_PAIRS and math.isfinite(x)):
            continue
        power, a = pairs - 3, math.asin(min(abs(x), 0.999999))
        slope = math.tan(a)
        width = min(math.pi / 2 - a, math.sqrt(slope * slope + 80 / power) - slope)
        at = a + (_NODES + 1) * width / 2
        tail = float(np.sum(_WEIGHTS * np.exp(power * np.log(np.cos(at))))) * width / 2
        half = (pairs - 2) / 2
        log_beta = math.lgamma(half) + math.lgamma(0.5) - math.lgamma(half + 0.5)
        out[k] = min(1.0, 2 * tail * math.exp(-log_beta))
    return out


@F.pandas_udf(DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    found = two_tailed(r.to_numpy(float), n.to_numpy(float))
    return pd.Series(np.where(np.isnan(found), None, found), dtype="object")


def p_value(r: Column, n: Column) -> Column:
    """Two-tailed p-value of a correlation; null below six pairs."""
    return _p_value(r, n)


def holm(edges: DataFrame, family: list[str], p: str = "p", alpha: float = 0.05, tie: str = "lag") -> DataFrame:
    """``edges`` with ``significant``: step-down within each family, ending at its first failure.  Null p: false."""
    inside = Window.partitionBy(*family)
    order = inside.orderBy(F.col(p).asc_nulls_last(), tie)
    limit = F.lit(alpha) / (F.count(p).over(inside) - F.row_number().over(order) + 1)
    passed = edges.withColumn("_pass", F.coalesce(F.col(p) <= F.when(F.col(p).isNotNull(), limit), F.lit(False)))
    return passed.withColumn("significant", F.bool_and("_pass").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_pass")


def _seed(text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    value = 2166136261
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        value = (value ^ unit) * 16777619 & 0xFFFFFFFF
    return value


def draws(seed: int, count: int) -> np.ndarray:
    """The first ``count`` numbers of the 32-bit counter generator, in [0, 1).

    The state after k draws is seed + k times a constant, so all are made at once.
    """
    with np.errstate(over="ignore"):
        state = np.uint32(seed) + np.arange(1, count + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)
        mixed = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
        mixed ^= mixed + (mixed ^ (mixed >> np.uint32(7))) * (mixed | np.uint32(61))
        return (mixed ^ (mixed >> np.uint32(14))).astype(np.float64) / 4294967296.0


def _rows_pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dx, dy = x - x.mean(-1, keepdims=True), y - y.mean(-1, keepdims=True)
    below = np.sqrt((dx * dx).sum(-1) * (dy * dy).sum(-1))
    return np.divide((dx * dy).sum(-1), below, out=np.zeros(below.shape), where=below > 0)


def block_bootstrap(x: np.ndarray, y: np.ndarray, seed_key: str, resamples: int = RESAMPLES) -> tuple[float, float, float, int, str]:
    """Median, 2.5 and 97.5 percentile, resamples used, stability of the correlation under moving blocks."""
    n = len(x)
    seen = float(_rows_pearson(x[None], y[None])[0]) if n else 0.0
    if n < LEAST_PAIRS:
        return seen, seen, seen, 0, "UNSTABLE"
    block = max(2, min(n // 3, math.floor(math.sqrt(n) + 0.5)))
    blocks = -(-n // block)
    starts = np.floor(draws(_seed(seed_key), resamples * blocks) * (n - block + 1)).astype(np.int64).reshape(resamples, blocks, 1)
    rows = (starts + np.arange(block)).reshape(resamples, -1)[:, :n]
    found = np.sort(_rows_pearson(x[rows], y[rows]))
    low, mid, high = (float(found[math.floor(q * (resamples - 1) + 0.5)]) for q in (0.025, 0.5, 0.975))
    share = 1.0 if seen == 0 else float(np.mean(np.sign(found) == np.sign(seen)))
    return mid, low, high, resamples, "STABLE" if share >= 0.9 else "MODERATE" if share >= 0.7 else "UNSTABLE"


def bootstrap(pairs: DataFrame, seed: Column) -> DataFrame:
    """signal, lag, median, low, high, resamples, stability of pairs (signal, lag, idx, x, y)."""
    schema = "signal string, lag bigint, median double, low double, high double, resamples bigint, stability string"

    def edge(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        made = block_bootstrap(rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows["seed"].iloc[0])
        return pd.DataFrame([(*key, *made)], columns=["signal", "lag", "median", "low", "high", "resamples", "stability"])

    return pairs.select("signal", F.col("lag").cast("bigint").alias("lag"), "idx", "x", "y", seed.alias("seed")).groupBy("signal", "lag").applyInPandas(edge, schema)
