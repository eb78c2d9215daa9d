"""Shared storage for intermediate results.

Intermediate frames go through ``DataFrame.checkpoint`` so that they live in the
folder named by ``spark.checkpoint.dir``, survive lost executors and are removed
by Spark's context cleaner once no plan refers to them.  Files that operators
write themselves (token shards, WARC archives) go to a fresh folder below the
same place.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, and where the session names no checkpoint folder, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/larkspur"
#: Bytes after which a batch of rows for a Python worker takes no more.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder: that of its settings, else the one set before.

    Where there is none, local mode gets a fallback; a cluster must name one.
    """
    context = spark.sparkContext
    named, before = context.getConf().get("spark.checkpoint.dir"), context._jsc.sc().getCheckpointDir()
    if not named and before.isDefined():
        return os.path.dirname(before.get().rstrip("/"))
    if not named and not context.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not before.isDefined():
        context.setCheckpointDir(named or FALLBACK_DIR)
    return named or FALLBACK_DIR


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES``, unless the session names a limit.

    Spark counts rows only, and 10,000 whole texts or sets take tens of MB in the JVM and
    several times that in each Python worker, of which a stage may feed four an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate frames as Parquet tables in the shared folder, which are smaller than
    checkpoints; those that are left are removed at the end of the block, also after a fault."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self._spark, name)
        self._paths[path] = None
        df.write.parquet(path)
        read = self._spark.read.schema(df.schema).parquet(path)
        self._paths[path] = read
        return read

    def drop(self, *frames: DataFrame) -> None:
        for path in [p for p, df in self._paths.items() if any(df is x for x in frames)]:
            remove_dir(self._spark, path)
            del self._paths[path]

    def __exit__(self, *_) -> None:
        for path in self._paths:
            remove_dir(self._spark, path)


def dealt(many: DataFrame, few: DataFrame, keys: list[str], by: str, shares: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join of a side with hot keys to one with a row a key: the rows of a key are
    dealt into shares by a hash of ``by``, and the short side is sent to each share."""
    left = many.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(shares)).cast("int"))
    right = few.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return left.join(right, [*keys, "_share"], how).drop("_share")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or bare path, or None for another store."""
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextlib.contextmanager
def open_output(uri: str):
    """Write a file that appears under its name only when complete.

    A task that is run again after a lost executor replaces the file with the
    same bytes; a half-written attempt is never visible to readers.
    """
    path = local_path(uri)
    attempt = f".{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + attempt, "wb") as out:
            yield out
        os.replace(path + attempt, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner + attempt) as out:
        yield out
    store.move(inner + attempt, inner)


@contextlib.contextmanager
def open_input(uri: str):
    """A seekable binary file."""
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as source:
            yield source
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_file(inner) as source:
        yield source
