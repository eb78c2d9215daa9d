"""Exact values at ranks of a whole column, or of each group, without a sort in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column) -> Column:
    """A number that never falls as the value rises: 256 steps for each doubling."""
    size = F.floor(F.log2(F.abs(value)) * 256) + 300_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def values_at(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: list[str] | None = None) -> DataFrame:
    """The groups with one column for each rank: the value at that place, from 0 on.

    A rank is given as an expression of the number of values; nulls, NaN and infinite
    values are not counted, and a null rank has no value.
    Values are counted, the counts are added up by buckets, and only the buckets that
    hold a wanted rank are sorted.  The running sums are over buckets, some ten
    thousand at most for each group, whatever the input.  Groups without a value
    have no row.
    """
    by = by or []
    counted = df.filter(F.abs(value) < float("inf")).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _bucket(F.col(value)))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = counted.groupBy(*by, "_b").agg(F.sum("_n").alias("_in")).withColumns({"_upto": F.sum("_in").over(group.orderBy("_b")), "_all": F.sum("_in").over(group)})
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_all")).cast("long").alias("rank")) for name, rank in ranks.items()])
    places = totals.select(*by, "_b", "_upto", "_in", F.explode(asked).alias("_r")).filter((F.col("_upto") > F.col("_r.rank")) & (F.col("_upto") - F.col("_in") <= F.col("_r.rank")))
    places = places.select(*by, "_b", F.col("_r.name").alias("_name"), (F.col("_r.rank") - F.col("_upto") + F.col("_in")).alias("_inner"))
    near = counted.join(places, [*by, "_b"])
    upto = F.sum("_n").over(Window.partitionBy(*by, "_b", "_name").orderBy(value))
    found = near.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_inner")).groupBy(*by, "_name").agg(F.min(value).alias("_v"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def medians(df: DataFrame, value: str, by: list[str] | None = None, out: str = "median") -> DataFrame:
    """The middle value of each group, or the mean of the two in the middle."""
    found = values_at(df, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)}, by)
    return found.select(*(by or []), ((F.col("_low") + F.col("_high")) / 2).alias(out))
