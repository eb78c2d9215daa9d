"""Results that are kept in the shared folder, so that later steps do not compute them anew."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, and where the session names no checkpoint folder, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/larkspur"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the one set before; a cluster must name one."""
    context = spark.sparkContext
    named, before = context.getConf().get("spark.checkpoint.dir"), context._jsc.sc().getCheckpointDir()
    if not named and before.isDefined():
        return os.path.dirname(before.get().rstrip("/"))
    if not named and not context.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not before.isDefined():
        context.setCheckpointDir(named or FALLBACK_DIR)
    return named or FALLBACK_DIR


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written; Spark removes it with the last plan on it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
