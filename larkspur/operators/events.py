"""Event-log investigation: counts, gap sessions, repeats, rarity and outliers.

Logs have event_id, entity_id, micros, event_type, value and source_row.  Times are
whole milliseconds, as gaps are judged in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.quantiles import medians, values_at

WINDOW_MS = 300_000


def with_millis(log: DataFrame) -> DataFrame:
    return log.withColumn("ms", F.expr("micros div 1000"))


def type_counts(log: DataFrame) -> DataFrame:
    """Count and share of each event type; the total is the sum of the counts."""
    counts = log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("event_type", "n", "total", (F.col("n") / F.col("total")).alias("share"))


def entity_activity(log: DataFrame) -> DataFrame:
    return with_millis(log).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


def profile(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("event_id").alias("ids"), (F.count("event_id") - F.countDistinct("event_id")).alias("duplicates"), F.countDistinct("entity_id").alias("entities"), F.count_if(F.col("micros").isNull()).alias("invalid"), F.min("micros").alias("first"), F.max("micros").alias("last"))


#: A key's log is cut into days; runs are numbered across the cuts.
DAY_MS = 86_400_000


def _same(keys: list[str], left: str, right: str) -> Column:
    """Equality of keys, null to null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def runs(log: DataFrame, keys: list[str], gap_ms: int = WINDOW_MS) -> DataFrame:
    """Events with the number of their run: neighbours at most ``gap_ms`` apart.

    A busy key is not sorted in one task: each day of it is, and what a day needs to
    know of the days before (their last event and number of runs) is one short row.
    """
    day = [*keys, "_day"]
    order = Window.partitionBy(*day).orderBy("ms", "source_row")
    inner = (F.col("ms") - F.lag("ms").over(order) > gap_ms).cast("int")
    rows = with_millis(log).withColumn("_day", F.floor(F.col("ms") / DAY_MS)).withColumn("_opens", F.coalesce(inner, F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_day")
    days = rows.groupBy(*day).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.sum("_opens").alias("inner"))
    days = days.withColumn("first", F.coalesce((F.col("lo") - F.lag("hi").over(before) > gap_ms).cast("int"), F.lit(1)))
    past = F.sum(F.col("inner") + F.col("first")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("base", F.coalesce(past, F.lit(0)) + F.col("first")).select(*day, "base")
    numbered = rows.withColumn("_within", F.sum("_opens").over(order))
    joined = numbered.alias("e").join(days.alias("d"), _same(day, "e", "d"))
    return joined.select("e.*", (F.col("d.base") + F.col("e._within")).alias("run")).drop("_day", "_opens", "_within")


def groups(log: DataFrame, keys: list[str], least: int) -> DataFrame:
    """One row for each run of ``least`` events or more: key, run, number, start, end, types."""
    made = runs(log, keys).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    return made.filter(F.col("n") >= least)


def sessions(log: DataFrame, keys: list[str], least: int, gap_ms: int = WINDOW_MS) -> DataFrame:
    """The events of runs of ``least`` events or more; an exact gap joins."""
    made = runs(log, keys, gap_ms)
    large = made.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return made.alias("e").join(large.alias("g"), _same([*keys, "run"], "e", "g")).select("e.*", "g.size")


def in_runs(log: DataFrame, flags: dict[str, tuple[list[str], int]], gap_ms: int = WINDOW_MS) -> DataFrame:
    """``log`` with a truth value for each of ``flags``: whether the event stands in a run of
    its keys with so many events or more, neighbours at most ``gap_ms`` apart.

    That depends on the nearest events only, so runs are neither numbered nor joined.
    A busy key is cut into days; events near midnight are also laid into the day beside,
    where they are seen and not returned.  All keys must begin with the same one: one
    shuffle by it and the day then serves all of them.
    """
    first = next(iter(flags.values()))[0][0]
    reach = gap_ms * (max(least for _, least in flags.values()) - 1)
    day = lambda shift: F.floor((F.col("ms") + shift) / DAY_MS)
    days = F.when(F.col("ms").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array(day(-reach), day(0), day(reach))))
    rows = with_millis(log).withColumn("_day", F.explode(days)).repartition(first, "_day")
    made = {}
    for name, (keys, least) in flags.items():
        order = Window.partitionBy(*keys, "_day").orderBy("ms", "source_row")
        # steps[k]: whether the k-th step around the event is short enough.
        at = lambda k: F.lead("ms", k).over(order) if k > 0 else F.lag("ms", -k).over(order) if k else F.col("ms")  # noqa: B023, E731
        steps = [F.coalesce(at(k + 1) - at(k) <= gap_ms, F.lit(False)) for k in range(-(least - 1), least - 1)]
        held = F.lit(False)
        for k in range(least):
            whole = F.lit(True)
            for step in steps[k : k + least - 1]:
                whole = whole & step
            held = held | whole
        made[name] = held
    return rows.withColumns(made).filter(F.col("ms").isNull() | (F.col("_day") == day(0))).drop("_day")


def median_gap(log: DataFrame) -> DataFrame:
    """median_gap_ms: of the gaps between consecutive events of the whole log.

    Equal times have gaps of 0, so the distinct times with their counts are enough;
    each day is sorted by itself and joined to the last time of the day before.
    """
    times = with_millis(log).filter("ms is not null").groupBy("ms").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.floor(F.col("ms") / DAY_MS))
    # One short row a day.
    ends = times.groupBy("day").agg(F.max("ms").alias("hi")).withColumn("before", F.lag("hi").over(Window.orderBy("day"))).select("day", "before")
    gap = F.col("ms") - F.coalesce(F.lag("ms").over(Window.partitionBy("day").orderBy("ms")), F.col("before"))
    gaps = times.join(F.broadcast(ends), "day").select(gap.alias("gap"), (F.col("n") - 1).alias("same"))
    zeros = gaps.agg(F.coalesce(F.sum("same"), F.lit(0)).alias("zeros"), F.count("gap").alias("others"))
    # Gaps of 0 stand before all others, so a rank among all is one among the others.
    counts = zeros.first()
    total = counts.zeros + counts.others
    if not total:
        return log.sparkSession.createDataFrame([(None,)], "median_gap_ms double")
    places = [(total - 1) // 2 - counts.zeros, total // 2 - counts.zeros]
    found = values_at(gaps.filter("gap is not null"), "gap", {f"v{i}": (lambda n, p=p: F.lit(max(p, 0))) for i, p in enumerate(places)}) if places[1] >= 0 else gaps.limit(1).select(F.lit(0).alias("v0"), F.lit(0).alias("v1"))
    of = [F.lit(0) if p < 0 else F.col(f"v{i}") for i, p in enumerate(places)]
    return found.select(((of[0] + of[1]) / 2).cast("double").alias("median_gap_ms"))


REPEAT = ["entity_id", "event_type", "value"]


def rare_types(log: DataFrame) -> DataFrame:
    counted = type_counts(log)
    return counted.filter(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") * 0.05)))


def value_bounds(log: DataFrame) -> DataFrame:
    """Bounds of the usual values: floor quantiles and 1.5 interquartile ranges, from four
    values on; no row below.  Values are taken at ranks, see ``values_at``.
    """
    at = lambda share: lambda n: F.when(n >= 4, F.floor((n - 1) * share))
    quart = values_at(log, "value", {"q1": at(0.25), "q3": at(0.75)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return quart.filter("q1 is not null").select("q1", "q3", F.round(F.col("q1") - reach, 12).alias("low"), F.round(F.col("q3") + reach, 12).alias("high"))


def outliers(log: DataFrame) -> DataFrame:
    return log.join(F.broadcast(value_bounds(log))).filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


FLAGS = ("rare", "odd", "burst", "again")


def notable(log: DataFrame) -> DataFrame:
    """Events with reasons; flags but ``rare`` attach by event id, so duplicate ids share them.

    The log is read three times: for its rows, its types and its values.
    """
    rare = rare_types(log).select("event_type", F.lit(True).alias("_rare"))
    rows = in_runs(log, {"burst": (["entity_id"], 3), "again": (REPEAT, 2)})
    # One row at most, and as many as there are types.
    bounds = value_bounds(log).agg(F.first("low").alias("_low"), F.first("high").alias("_high"))
    rows = rows.join(F.broadcast(bounds)).join(rare, "event_type", "left")
    rows = rows.withColumns({"rare": F.coalesce("_rare", F.lit(False)), "odd": F.coalesce((F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high")), F.lit(False))})
    # Events without an id share nothing; they are spread by their rows.
    own = Window.partitionBy("event_id", F.when(F.col("event_id").isNull(), F.col("source_row")))
    shared = {c: F.max(c).over(own) & F.col("event_id").isNotNull() for c in FLAGS[1:]}
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in FLAGS]))
    return rows.withColumns(shared).withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*log.columns, "reasons")


def reason_texts(marked: DataFrame) -> DataFrame:
    """Notable events with their reasons as sentences, in the order of the rules."""
    known = F.create_map(
        *[
            x
            for name, text in (
                ("rare", F.concat(F.lit("тип события «"), F.col("event_type"), F.lit("» встречается не чаще опубликованного порога 5%"))),
                ("odd", F.lit("значение выходит за опубликованные границы 1.5×IQR")),
                ("burst", F.lit("событие входит в скопление одной сущности минимум из трёх событий с промежутками не более пяти минут")),
                ("again", F.lit("событие повторяет ту же сущность/тип/значение в течение пяти минут")),
            )
            for x in (F.lit(name), text)
        ]
    )
    return marked.withColumn("reasons", F.transform("reasons", lambda r: F.element_at(known, r)))


def entity_detail(log: DataFrame, entity: str) -> DataFrame:
    """One entity: its activity, notable events, clusters and why it is highlighted."""
    mine = F.col("entity_id") == entity
    marks = notable(log).filter(mine).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("notable"), F.count(F.lit(1)).alias("_marked"))
    near = groups(log.filter(mine), ["entity_id"], 2).agg(F.count(F.lit(1)).alias("clusters"))
    middle = medians(log.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "n")
    rows = entity_activity(log.filter(mine)).join(F.broadcast(marks)).join(F.broadcast(near)).join(F.broadcast(middle))
    why = F.concat_ws(",", F.when(F.col("n") > F.col("median"), "busy"), F.when(F.col("_marked") > 0, "notable"))
    return rows.withColumn("reasons", why).drop("_marked", "median")


def highlighted(log: DataFrame) -> DataFrame:
    """Entities busier than the median, or with notable events."""
    counts = log.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    marks = notable(log).groupBy("entity_id").agg(F.count(F.lit(1)).alias("notable"))
    middle = medians(counts, "n")
    return counts.join(marks, "entity_id", "left").fillna(0, ["notable"]).join(F.broadcast(middle)).filter((F.col("n") > F.col("median")) | (F.col("notable") > 0))
