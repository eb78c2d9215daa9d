"""What-if over a declared linear chain of metrics, one row a baseline and step.

Every row is computed from its own columns; a sweep multiplies the rows by at
most 101 steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a coefficient may come from.
PROVENANCE = ("demo_calibration", "domain_calibration", "historical_estimate", "configured_assumption")


@dataclass(frozen=True)
class Effect:
    source: str
    target: str
    coefficient: float
    kind: str = "configured_assumption"
    note: str = ""


@dataclass(frozen=True)
class Bound:
    metric: str
    low: float
    high_metric: str | None = None


@dataclass(frozen=True)
class Scenario:
    """Control metric, its grid of changes in percent, and the chain that follows it."""

    control: str
    least: float
    most: float
    step: float
    increase: bool
    effects: tuple[Effect, ...]
    bounds: tuple[Bound, ...] = ()
    cap: str | None = None
    target: str | None = None
    threshold: float | None = None
    problems: list[str] = field(default_factory=list, compare=False)

    def validate(self) -> None:
        grid = (self.least, self.most, self.step)
        if not all(map(math.isfinite, grid)) or self.step <= 0 or self.least < 0 or self.most < self.least or (self.most - self.least) / self.step > 100:
            raise ValueError("the grid of changes is not valid")
        reached = {self.control}
        for e in self.effects:
            if not math.isfinite(e.coefficient) or not e.note.strip() or e.kind not in PROVENANCE:
                raise ValueError(f"the effect on {e.target} has no valid coefficient or provenance")
            if e.source not in reached or e.target in reached:
                raise ValueError("effects must be an ordered chain without cycles")
            reached.add(e.target)
        if not all(math.isfinite(b.low) for b in self.bounds):
            raise ValueError("a bound is not finite")

    def steps(self) -> list[float]:
        return [self.least + k * self.step for k in range(math.floor((self.most - self.least) / self.step) + 1)]

    def metrics(self) -> list[str]:
        names = [self.control, self.cap, *(m for e in self.effects for m in (e.source, e.target)), *(m for b in self.bounds for m in (b.metric, b.high_metric))]
        return list(dict.fromkeys(m for m in names if m))


def _finite(name: str):
    return F.coalesce(F.abs(F.col(name)) < float("inf"), F.lit(False)) & ~F.isnan(name)


def _within(s: Scenario, of) -> object:
    ok = F.lit(True)
    for b in s.bounds:
        ok = ok & (of(b.metric) >= b.low)
        if b.high_metric:
            ok = ok & (of(b.metric) <= of(b.high_metric))
    return ok


def simulate(baselines: DataFrame, s: Scenario, change: str = "change_pct") -> DataFrame:
    """``baselines`` with ``available``, ``bounded`` and a ``<metric>_after`` for the control and each target.

    A row whose metrics are not finite, that breaks a bound before or after, or
    whose change is off the grid is not available; its results are null.
    """
    s.validate()
    pct, k = F.col(change), (F.col(change) - s.least) / s.step
    ready = F.coalesce((pct >= s.least) & (pct <= s.most) & (F.abs(k - F.round(k)) <= 1e-8), F.lit(False))
    for m in s.metrics():
        ready = ready & _finite(m)
    ready = ready & _within(s, F.col)
    if s.cap:
        ready = ready & (F.col(s.control) <= F.col(s.cap))

    out = baselines.withColumn("_asked", F.col(s.control) * (1 + (1 if s.increase else -1) * pct / 100))
    moved = F.least("_asked", s.cap) if s.cap else F.col("_asked")
    out = out.withColumn(f"{s.control}_after", moved)
    bounded = F.col(f"{s.control}_after") != F.col("_asked")
    after = {s.control}

    def now(metric: str):
        return F.col(f"{metric}_after" if metric in after else metric)

    for e in s.effects:
        free = F.col(e.target) + (now(e.source) - F.col(e.source)) * e.coefficient
        held = free
        for b in (b for b in s.bounds if b.metric == e.target):
            held = F.least(held, now(b.high_metric)) if b.high_metric else held
            held = F.greatest(F.lit(b.low), held)
        out = out.withColumns({f"{e.target}_after": held, f"_free_{e.target}": free})
        bounded = bounded | (F.col(f"{e.target}_after") != F.col(f"_free_{e.target}"))
        after.add(e.target)
    ready = ready & _within(s, now)
    for m in after:
        ready = ready & _finite(f"{m}_after")
    out = out.withColumns({"available": F.coalesce(ready, F.lit(False)), "bounded": bounded})
    shown = {f"{m}_after": F.when(F.col("available"), F.col(f"{m}_after")) for m in sorted(after)}
    hidden = ["_asked", *(f"_free_{e.target}" for e in s.effects)]
    return out.withColumns(shown | {"bounded": F.when(F.col("available"), F.col("bounded"))}).drop(*hidden)


def sweep(baselines: DataFrame, s: Scenario) -> DataFrame:
    """All steps of the grid for every baseline, with ``reaches``: the target is at or below its threshold."""
    s.validate()
    grid = baselines.withColumn("change_pct", F.explode(F.array(*[F.lit(float(x)) for x in s.steps()])))
    return simulate(grid, s).withColumn("reaches", F.col("available") & (F.col(f"{s.target}_after") <= s.threshold))


def recommend(baselines: DataFrame, s: Scenario, key: str) -> DataFrame:
    """key, status and the least change that reaches the target, if any."""
    least = F.min(F.when(F.col("reaches"), F.col("change_pct")))
    found = sweep(baselines, s).groupBy(key).agg(least.alias("change_pct"), F.bool_or("available").alias("any"))
    status = F.when(F.col("change_pct").isNotNull(), "TARGET_REACHED").when(F.col("any"), "TARGET_NOT_REACHED").otherwise("NO_VALID_SCENARIO")
    return found.select(key, status.alias("status"), "change_pct")
