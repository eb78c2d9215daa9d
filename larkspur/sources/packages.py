"""Review packages of scenarios: one canonical JSON text for each baseline.

A package holds what was observed, the asked change, the assumptions behind it and the
whole sweep of the control, so that a reader can check it.  Its bytes follow from its
rows alone; files are verified by computing all packages again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.canonical import canonical, digest_of
from larkspur.functions.columns import rounded
from larkspur.operators.scenario import Scenario, sweep
from larkspur.sources.stores import Store

#: The format's name and its disclaimer.
FORMAT = "MODEL_REVIEW_PACKAGE"
DISCLAIMER = "Сценарная рекомендация для операционной проверки. Не наблюдаемый результат, не прогноз, не доказанно оптимальное решение. Строительное вмешательство не выполнено."


def _held(c: Column, digits: int) -> Column:
    return rounded(c.cast("double"), digits)


def _impacts(s: Scenario, digits: int) -> Column:
    """What follows the control: a struct for each effect, in the order of the chain."""
    out = []
    for e in s.effects:
        before, after = F.col(e.target).cast("double"), F.col(f"{e.target}_after").cast("double")
        relative = F.when(before != 0, (after - before) / F.abs(before) * 100)
        out.append(F.struct(F.lit(e.target).alias("metric"), _held(before, digits).alias("baselineValue"), _held(after, digits).alias("simulatedValue"), _held(after - before, digits).alias("absoluteChange"), _held(relative, digits).alias("relativeChangePct")))
    return F.array(*out)


def packages(baselines: DataFrame, s: Scenario, key: str, change: float, validated_hash: Column, digits: int = 6) -> DataFrame:
    """key, status and package of every baseline; no package where the change is not available.

    ``validated_hash`` names the result that a baseline comes from.  A baseline has as
    many steps as the control's grid, 101 at most, which one row gathers.
    """
    before, after = F.col(s.control).cast("double"), F.col(f"{s.control}_after").cast("double")
    step = F.struct(
        F.col("change_pct").cast("double").alias("changePct"),
        _held(before, digits).alias("baselineValue"),
        _held(before * (1 + (1 if s.increase else -1) * F.col("change_pct") / 100), digits).alias("requestedUnboundedValue"),
        _held(after, digits).alias("scenarioValue"),
        _held(F.when(before != 0, (after - before) / F.abs(before) * 100), digits).alias("effectiveChangePct"),
        F.col("bounded").alias("bounded"),
        _impacts(s, digits).alias("impacts"),
        _held(F.col(f"{s.target}_after"), digits).alias("targetValue"),
        F.col("reaches").alias("reachesTarget"),
    )
    swept = sweep(baselines.withColumn("_hash", validated_hash.cast("string")), s)
    gathered = swept.filter("available").groupBy(key).agg(F.first("_hash").alias("_hash"), F.array_sort(F.collect_list(step)).alias("_steps"))
    asked = F.get(F.filter("_steps", lambda x: x["changePct"] == float(change)), F.lit(0))
    least = F.get(F.filter("_steps", lambda x: x["reachesTarget"]), F.lit(0))
    found = gathered.select(key, "_hash", "_steps", asked.alias("_asked"), least.alias("_least"))
    effects = F.array(*[F.struct(F.lit(e.source).alias("sourceMetric"), F.lit(e.target).alias("targetMetric"), F.lit(float(e.coefficient)).alias("effectCoefficient"), F.struct(F.lit(e.kind).alias("kind"), F.lit(e.note).alias("note")).alias("provenance")) for e in s.effects])
    package = F.struct(
        F.lit(FORMAT).alias("format"),
        F.col("_hash").alias("validatedArtifactHash"),
        F.struct(F.lit("OBSERVED").alias("kind"), F.lit(s.target).alias("target"), F.col("_asked.baselineValue").alias("latestValue")).alias("observed"),
        F.struct(F.lit("SIMULATION").alias("kind"), F.lit(s.control).alias("controlMetric"), F.col("_asked").alias("result")).alias("scenario"),
        F.struct(F.lit("MODEL_ASSUMPTION").alias("kind"), effects.alias("relationships")).alias("assumptions"),
        F.struct(
            F.lit("INTERVENTION_ANALYSIS").alias("kind"),
            F.when(F.col("_least").isNotNull(), "TARGET_REACHED").otherwise("TARGET_NOT_REACHED").alias("status"),
            F.lit(s.control).alias("controlMetric"),
            F.lit(s.target).alias("targetMetric"),
            F.lit(float(s.threshold)).alias("targetThreshold"),
            F.col("_steps").alias("candidates"),
            F.col("_least").alias("recommendedCandidate"),
        ).alias("intervention"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
    made = found.withColumn("_package", package)
    text = canonical(F.col("_package"), made.schema["_package"].dataType)
    ready = made.select(key, F.when(F.col("_asked").isNotNull(), text).alias("package"))
    joined = baselines.select(key).distinct().join(ready, key, "left")
    return joined.select(key, F.when(F.col("package").isNotNull(), "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), "package")


def write_packages(made: DataFrame, path: str) -> str:
    """Packages as lines of text files, staged, read back and renamed; their digest."""
    spark = made.sparkSession
    store, staged = Store(spark, path), f"{path}.staged"
    lines = made.filter("package is not null").select("package")
    store.delete(staged)
    lines.write.option("lineSep", "\n").text(staged)
    digest = verify_packages(made, staged)
    store.delete(path)
    store.rename(staged, path)
    return digest


def verify_packages(made: DataFrame, path: str) -> str:
    """The digest of the packages, if files hold exactly these; raises where they differ."""
    spark = made.sparkSession
    wanted = made.filter("package is not null").agg(digest_of(F.col("package")).alias("d")).first()["d"]
    got = spark.read.option("lineSep", "\n").text(path).agg(digest_of(F.col("value")).alias("d")).first()["d"]
    if wanted != got:
        raise ValueError(f"packages differ: {wanted} computed, {got} read")
    return got
