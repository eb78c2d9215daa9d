"""Small files, renames and placed lines in whatever store Spark writes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, before: str, after: str) -> None:
        self._fs.mkdirs(self._path(after).getParent())
        if self.exists(after) or not self._fs.rename(self._path(before), self._path(after)):
            raise OSError(f"{before} can't become {after}")

    def read(self, path: str) -> str:
        source = self._fs.open(self._path(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def write(self, path: str, text: str) -> None:
        """A small file that appears under its name when it is complete."""
        part = f"{path}.part"
        out = self._fs.create(self._path(part), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(part, path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (position, line) as text files; joined in the order of their names they are the file."""
    dealt = lines.select("position", "line").repartitionByRange("position").sortWithinPartitions("position")
    dealt.select("line").write.option("lineSep", "\n").mode("overwrite").text(path)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0 on) and line of text files that ``write_lines`` made.

    A piece of a file lies in one partition, where rows keep their order; only the number
    of lines of each piece is added up over the pieces.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    pieces = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select("_file", "_block", "_first", before.alias("_before"))
    return rows.join(F.broadcast(starts), ["_file", "_block"]).select((F.col("_before") + F.col("_at") - F.col("_first")).alias("position"), "line")
