"""Whether a result can be trusted: recomputed, resolved and fingerprinted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> dict[str, object]:
    """Rows and the sum of row hashes: the same for any order and partitioning."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("h")).first()
    return {"rows": found["n"], "hash": str(found["h"] or 0)}


def same_rows(claimed: DataFrame, recomputed: DataFrame) -> bool:
    """The same rows as often on both sides; columns are matched by name."""
    names = sorted(claimed.columns)
    if names != sorted(recomputed.columns):
        return False
    left, right = claimed.select(*names), recomputed.select(*names)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def unresolved(references: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """References without a row; null references count."""
    return references.join(rows.select(key).distinct(), key, "left_anti")


def publish(df: DataFrame, expected: dict[str, object]) -> DataFrame:
    """``df``, if it is what was validated."""
    if fingerprint(df) != expected:
        raise ValueError("rows changed since they were validated")
    return df
