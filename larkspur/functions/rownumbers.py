"""Running row numbers without a global sort or a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import kept


def numbered(df: DataFrame, out: str, first: int = 0) -> DataFrame:
    """``df`` with a number for each row, in the order of its partitions and their rows.

    Rows are written with their partition and their place in it, so that a task that
    runs again can't renumber them.  Only the sizes of partitions are added up, a row
    for each partition, and they are the side that is broadcast.
    """
    place = F.monotonically_increasing_id()
    rows = kept(df.withColumns({"__part": F.shiftright(place, 33), "__place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return rows.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col("__place") + first).drop("__part", "__place", "__before")
