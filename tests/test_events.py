"""Runs, flags and quantiles of event logs against plain search."""

import random

import pytest

from larkspur.functions.quantiles import medians, values_at
from larkspur.operators import events as E
from pyspark.sql import functions as F

LOG = "event_id string, entity_id string, micros long, event_type string, value double, source_row long"
DAY = 86_400_000


def log_of(spark, seed=2, n=400):
    """Events close to midnights and far from them, with ties, gaps and null times."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ms = rng.choice([rng.randrange(3 * DAY), DAY * rng.randrange(1, 3) + rng.randrange(-700_000, 700_000), 600_000 * rng.randrange(5)])
        rows.append((f"e{rng.randrange(n * 3 // 4)}" if k % 40 else None, rng.choice("uvw") if k % 50 else None, None if k % 90 == 7 else ms * 1000 + rng.randrange(1000), rng.choice("ab"), rng.choice([1.0, 2.0, None]), k))
    return rows, spark.createDataFrame(rows, LOG)


def plain_runs(rows, key, least, gap=300_000):
    groups, found = {}, set()
    for r in rows:
        if r[2] is not None:
            groups.setdefault(key(r), []).append((r[2] // 1000, r[5]))
    for events in groups.values():
        events.sort()
        run = [events[0]]
        for e in events[1:]:
            if e[0] - run[-1][0] > gap:
                found |= {x[1] for x in run} if len(run) >= least else set()
                run = []
            run.append(e)
        found |= {x[1] for x in run} if len(run) >= least else set()
    return found


@pytest.mark.parametrize("least", [2, 3, 5])
def test_events_in_runs(spark, least):
    rows, log = log_of(spark, least)
    flags = {"one": (["entity_id"], least), "two": (["entity_id", "event_type", "value"], 2)}
    got = E.in_runs(log, flags).collect()
    assert len(got) == len(rows) and {r.source_row for r in got} == set(range(len(rows)))
    assert {r.source_row for r in got if r.one} == plain_runs(rows, lambda r: r[1], least)
    assert {r.source_row for r in got if r.two} == plain_runs(rows, lambda r: (r[1], r[3], r[4]), 2)


def test_duplicate_ids_share_flags_and_missing_ones_do_not(spark):
    base = [(f"x{k}", f"u{k}", k * DAY * 1000, "a", 1.0, k) for k in range(100, 130)]
    rows = base + [("d", "u", 0, "a", 1.0, 1), ("q", "u", 1000, "a", 1.0, 2), ("d", "other", 9 * DAY * 1000, "a", 5.0, 3), (None, "z", 0, "a", 1.0, 4), (None, "z", 0, "a", 1.0, 5), ("t", "solo", 0, "seldom", 1.0, 6)]
    got = {r.source_row: r.reasons for r in E.notable(spark.createDataFrame(rows, LOG)).collect()}
    # Value 5 lies outside of bounds that are one point wide, and d shares that, too.
    assert got == {1: ["odd", "again"], 2: ["again"], 3: ["odd", "again"], 6: ["rare"]}


def test_values_that_are_not_finite_are_not_counted(spark):
    rows = [(1, float("inf")), (1, float("-inf")), (1, float("nan")), (1, None), (1, 3.0), (1, 5.0), (2, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double")
    assert [tuple(r) for r in medians(df, "x", ["g"]).collect()] == [(1, 4.0)]
    assert values_at(df, "x", {"a": lambda n: F.when(n > 9, 0)}).first().a is None
    log = spark.createDataFrame([("e", "u", 0, "a", v, k) for k, v in enumerate([1.0, 2.0, 3.0, float("inf")])], LOG)
    assert E.value_bounds(log).count() == 0 and E.outliers(log).count() == 0
