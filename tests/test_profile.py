"""Ranks, runs across days, shapes and structures on small fixtures with nulls and ties."""

import math
import random

from pyspark.sql import functions as F

from larkspur.functions.quantiles import medians, values_at
from larkspur.operators import events as E
from larkspur.operators import profile as P
from larkspur.operators import replenishment as R


def test_values_at_ranks_against_sorting(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, 0.0, -5.5, 1e-9, 1e12, rng.uniform(-3, 3), float(rng.randrange(4))])) for g in "abc" for _ in range(200)] + [("d", None), ("e", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.low, r.high) for r in values_at(df, "x", {"low": lambda n: F.floor((n - 1) * 0.25), "high": lambda n: n - 1}, ["g"]).collect()}
    middle = {r.g: r.median for r in medians(df, "x", ["g"]).collect()}
    for g in "abce":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[math.floor((len(v) - 1) * 0.25)], v[-1])
        assert middle[g] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert "d" not in got and medians(df.limit(0), "x", ["g"]).count() == 0


def brute_runs(rows, gap):
    out, before = [], None
    for ms, row in sorted(rows):
        if before is None or ms - before > gap:
            out.append([])
        out[-1].append(row)
        before = ms
    return out


def test_runs_go_on_over_days_and_null_keys(spark):
    rng = random.Random(6)
    day = E.DAY_MS
    rows = []
    for n, key in enumerate(["a", None, "b"]):
        at = 0
        for k in range(300):
            at += rng.choice([0, 1000, 299_999, 300_000, 300_001, day // 3, 2 * day])
            rows.append((f"{n}-{k}", key, (at + n) * 1000, "t", 1.0, n * 1000 + k))
    for k in range(1000):
        rows.append((f"c-{k}", "c", k * 300_000 * 1000, "t", 1.0, 9000 + k))
    log = spark.createDataFrame(rows, "event_id string, entity_id string, micros long, event_type string, value double, source_row long")
    made: dict = {}
    for r in E.runs(log, ["entity_id"]).collect():
        made.setdefault((r.entity_id, r.run), []).append(r.source_row)
    for key in ("a", None, "b", "c"):
        want = brute_runs([(m // 1000, row) for _, k, m, _, _, row in rows if k == key], E.WINDOW_MS)
        assert sorted(sorted(v) for (k, _), v in made.items() if k == key) == sorted(sorted(x) for x in want)
    times = sorted(m // 1000 for _, _, m, *_ in rows)
    gaps = sorted(b - a for a, b in zip(times, times[1:]))
    want = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2
    assert E.median_gap(log).first().median_gap_ms == want
    assert E.median_gap(log.limit(1)).first().median_gap_ms is None
    assert E.median_gap(log.limit(1).union(log.limit(1))).first().median_gap_ms == 0.0


def test_periods(spark):
    texts = ["2024-W01", "2020-W53", "2021-W53", "2024-13", "2024-02", "31.12.2023", "31/12.2023", "30.02.2024", "2024-02-29", "2023-02-29", "2024-01-02T03:04:05Z", "20240102", "45000", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.period_time(F.col("t")).cast("string")).collect()]
    assert got == ["2024-01-01 00:00:00", "2020-12-28 00:00:00", None, None, "2024-02-01 00:00:00", "2023-12-31 00:00:00", None, None, "2024-02-29 00:00:00", None, "2024-01-02 03:04:05", None, None, None]


def test_falls_are_seen_between_blocks(spark):
    rising = spark.createDataFrame([(k * 60_000, f"2024-01-{k + 1:02d}", 1.0) for k in range(6)], "at long, date string, x double")
    assert P.shape(rising, ["date", "x"], "at", {}).first().tag == "TIME_SERIES"
    falling = spark.createDataFrame([(k * 60_000, f"2024-01-{(k + 1) if k != 2 else 1:02d}", 1.0) for k in range(6)], "at long, date string, x double")
    assert P.shape(falling, ["date", "x"], "at", {}).first().tag == "AMBIGUOUS_TABULAR"


def test_profile_of_empty_and_odd_columns(spark):
    rows = [(1, None, "true", "2024-01-01", "1"), (2, "", "false", "2024-01-02", "x"), (3, " ", None, None, "2")]
    table = spark.createDataFrame(rows, "k int, none string, truth string, date string, mixed string")
    kinds = {r.name: (r.kind, r.n, r.missing, r["first"]) for r in P.column_profile(table, ["none", "truth", "date", "mixed"], "k").collect()}
    assert kinds == {"none": ("empty", 0, 3, None), "truth": ("boolean", 2, 1, "true"), "date": ("datetime", 2, 1, "2024-01-01"), "mixed": ("categorical", 3, 0, "1")}


def test_messages_count_what_they_do_not_show(spark):
    lines = spark.createDataFrame([("s", f"k{k}", f"Name  {k}", float(k)) for k in range(1, 6)] + [("s", "k9", "none", 0.0), ("r", "z", "Z", 1.5)], "supplier string, sku string, product_name string, quantity double")
    got = {r.supplier: r.message.split("\n") for r in R.order_messages(lines, "2024-01", 3).collect()}
    assert got["s"][3:7] == ["1. k1 — 1 шт. · Name 1", "2. k2 — 2 шт. · Name 2", "3. k3 — 3 шт. · Name 3", "…ещё 2 поз. — полный перечень в приложенном CSV."]
    assert got["s"][8] == "Итого: 5 поз., 15 шт." and got["r"][3] == "1. z — 1.5 шт. · Z" and got["r"][5] == "Итого: 1 поз., 1.5 шт."
