"""Cross-sections: what goes with a target, and which rows stand out.

Target and predictors come from the table's own columns (``roles``).  All numbers of a
table are aggregated in one wide pass; columns of classes are turned into rows of
(predictor, value) and grouped once, so one very common class is added up before it moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import numeric_cell
from larkspur.functions.quantiles import values_at
from larkspur.operators import roles as R

METHODS = ("PEARSON", "NUMERIC_BY_TARGET_GROUP", "GROUP_MEAN_RANGE", "CONTINGENCY")
#: Bounds that put a context flag on a row, by the role of the column.
HIGH = ("HIGH", "HIGH_RISK", "CRITICAL", "YES", "TRUE", "1", "ВЫСОКИЙ", "КРИТИЧЕСКИЙ", "ДА")
RATING_BELOW, DTI_SHARE, DTI_PERCENT = 600, 0.4, 40

GROUPS = "method string, predictor string, value string, target_value string, n bigint, mean double"


def _text(c: str) -> Column:
    cell = F.col(f"`{c}`").cast("string")
    return F.when(cell != "", cell)


def _number(c: str) -> Column:
    return numeric_cell(F.col(f"`{c}`"))


class Section:
    """A table with its target, key and predictors."""

    def __init__(self, df: DataFrame, explicit: str | None = None):
        self.df, self.kinds = df, R.kinds(df)
        self.target = R.resolve_target(df, explicit, self.kinds)
        self.entity = R.entity_column(df)
        free = [c for c in df.columns if c not in (self.entity, self.target.column)]
        self.numbers = [c for c in free if self.kinds[c] == "numeric"]
        self.classes = [c for c in free if self.kinds[c] == "categorical"]

    def _classes(self, y: Column) -> DataFrame:
        """predictor, value, y: a row for each cell of a class that is there, with the target."""
        cells = F.array(*[F.struct(F.lit(c).alias("predictor"), _text(c).alias("value")) for c in self.classes])
        return self.df.select(y.alias("y"), F.explode(cells).alias("e")).select("e.*", "y").filter("value is not null and y is not null")

    def groups(self) -> DataFrame:
        """method, predictor, value, target_value, n, mean: the groups of every relation to
        the target, and the cells of contingencies."""
        t, parts = self.target, [self.df.sparkSession.createDataFrame([], GROUPS)]
        if t.kind == "NUMERIC" and self.classes:
            found = self._classes(_number(t.column)).groupBy("predictor", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
            parts.append(found.select(F.lit("GROUP_MEAN_RANGE").alias("method"), "predictor", "value", F.lit(None).cast("string").alias("target_value"), "n", "mean"))
        if t.kind == "CATEGORICAL" and self.numbers:
            wide = self.df.groupBy(_text(t.column).alias("value")).agg(*[F.struct(F.count(_number(c)).alias("n"), F.avg(_number(c)).alias("mean")).alias(f"c{k}") for k, c in enumerate(self.numbers)]).filter("value is not null")
            long = wide.select("value", F.explode(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(f"c{k}.n").alias("n"), F.col(f"c{k}.mean").alias("mean")) for k, c in enumerate(self.numbers)])).alias("e"))
            parts.append(long.filter("e.n > 0").select(F.lit("NUMERIC_BY_TARGET_GROUP").alias("method"), "e.predictor", "value", F.lit(None).cast("string").alias("target_value"), "e.n", "e.mean"))
        if t.kind == "CATEGORICAL" and self.classes:
            cells = self._classes(_text(t.column)).groupBy("predictor", "value", "y").agg(F.count(F.lit(1)).alias("n"))
            parts.append(cells.select(F.lit("CONTINGENCY").alias("method"), "predictor", "value", F.col("y").alias("target_value"), "n", F.lit(None).cast("double").alias("mean")))
        return reduce(DataFrame.unionByName, parts)

    def associations(self, groups: DataFrame | None = None) -> DataFrame:
        """method, predictor, n, value, strength: correlations of numbers, spreads of group
        means in deviations, and contingencies, which have no strength."""
        t, groups = self.target, self.groups() if groups is None else groups
        numbers = ([t.column] if t.kind == "NUMERIC" else []) + (self.numbers if t.kind else [])
        if not numbers:
            wide = self.df.limit(0).agg(F.count(F.lit(1)).alias("none"))
        else:
            pairs = []
            for c in self.numbers if t.kind == "NUMERIC" else []:
                x, y = _number(c), _number(t.column)
                both = x.isNotNull() & y.isNotNull()
                x, y = F.when(both, x), F.when(both, y)
                r = F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))
                pairs.append(F.struct(F.lit(c).alias("predictor"), F.count(x).alias("n"), r.alias("r")))
            sd = F.struct(*[F.stddev_pop(_number(c)).alias(f"c{k}") for k, c in enumerate(numbers)])
            wide = self.df.agg((F.array(*pairs) if pairs else F.array().cast("array<struct<predictor:string,n:bigint,r:double>>")).alias("pairs"), sd.alias("sd"))
        spec = "method string, predictor string, n bigint, value double, strength double"
        if not numbers:
            first, deviations = self.df.sparkSession.createDataFrame([], spec), self.df.sparkSession.createDataFrame([], "column string, sd double")
        else:
            first = wide.select(F.explode("pairs").alias("p")).filter("p.n >= 3").select(F.lit("PEARSON").alias("method"), "p.predictor", "p.n", F.col("p.r").alias("value"), F.abs("p.r").alias("strength"))
            deviations = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"sd.c{k}").alias("sd")) for k, c in enumerate(numbers)])).alias("d")).select("d.*")
        spread = groups.filter("method <> 'CONTINGENCY'").groupBy("method", "predictor").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.max("mean") - F.min("mean")).alias("reach")).filter("k > 1")
        # Means of the target are measured in its deviations, means of a predictor in its own.
        scale = F.when(F.col("method") == "GROUP_MEAN_RANGE", F.lit(t.column)).otherwise(F.col("predictor"))
        strength = F.when(F.col("sd") > 0, F.col("reach") / F.col("sd")).otherwise(0.0)
        second = spread.withColumn("column", scale).join(F.broadcast(deviations), "column").select("method", "predictor", "n", F.lit(None).cast("double").alias("value"), strength.alias("strength"))
        tables = groups.filter("method = 'CONTINGENCY'").groupBy("method", "predictor").agg(F.sum("n").alias("n")).select("method", "predictor", "n", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("strength"))
        return first.unionByName(second).unionByName(tables)

    def drivers(self, associations: DataFrame | None = None, most: int = 5) -> DataFrame:
        """rank, method, predictor and strength of the first relations that have one."""
        found = self.associations() if associations is None else associations
        order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
        chosen = found.filter("strength is not null").orderBy(order, F.desc("strength"), "predictor").limit(most)
        ranked = chosen.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), (-F.col("strength")).alias("s"), "predictor", "method", "strength"))).alias("d"))
        return ranked.select(F.posexplode("d").alias("k", "e")).select((F.col("k") + 1).cast("bigint").alias("rank"), "e.method", "e.predictor", "e.strength")

    def numeric_summaries(self) -> DataFrame:
        """column, n, missing, low, high, mean, deviation of all numeric columns but the key."""
        names = [c for c in self.df.columns if self.kinds[c] == "numeric" and c != self.entity]
        if not names:
            return self.df.sparkSession.createDataFrame([], "column string, n bigint, missing bigint, low double, high double, mean double, deviation double")
        of = lambda c: F.struct(F.lit(c).alias("column"), F.count(_number(c)).alias("n"), F.count_if(_number(c).isNull()).alias("missing"), F.min(_number(c)).alias("low"), F.max(_number(c)).alias("high"), F.round(F.avg(_number(c)), 12).alias("mean"), F.round(F.stddev_pop(_number(c)), 12).alias("deviation"))
        return self.df.agg(F.array(*[of(c) for c in names]).alias("a")).select(F.explode("a").alias("s")).select("s.*")

    def category_counts(self) -> DataFrame:
        """predictor, value, n of all columns of classes but the key."""
        names = [c for c in self.df.columns if self.kinds[c] == "categorical" and c != self.entity]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in names]) if names else F.array().cast("array<struct<column:string,value:string>>")
        return self.df.select(F.explode(cells).alias("e")).select("e.*").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))

    def prevalence(self) -> DataFrame:
        """columns, affected, total: rows with a delinquency of either kind."""
        columns = [c for c in (R.column_of(self.df.columns, r) for r in ("CURRENT_DELINQUENCY", "DELINQUENCIES_12M")) if c]
        hit = reduce(lambda a, b: a | b, [F.coalesce(_number(c) > 0, F.lit(False)) for c in columns], F.lit(False))
        return self.df.agg(F.count_if(hit).alias("affected"), F.count(F.lit(1)).alias("total")).select(F.lit("|".join(columns) or None).cast("string").alias("columns"), "affected", "total", (F.when(F.lit(bool(columns)), F.round(F.col("affected") / F.col("total"), 12))).alias("rate"))

    def high_risk(self, row: str) -> DataFrame:
        """entity_id, source_row, target_value, bound and flags of the rows that stand out.

        ``row`` names a column of row numbers.  Numeric targets are taken from the value at
        place ceil(3n/4) on, classes by a label of high risk.
        """
        t = self.target
        schema = "entity_id string, source_row bigint, target_value string, bound double, flags string"
        if not t.column:
            return self.df.sparkSession.createDataFrame([], schema)
        own = F.concat(F.lit("ROW-"), F.col(row).cast("string")) if self.entity == R.SOURCE_ROW else F.col(f"`{self.entity}`").cast("string")
        shown = [own.alias("entity_id"), F.col(row).cast("bigint").alias("source_row")]
        if t.kind == "CATEGORICAL":
            label = F.col(f"`{t.column}`").cast("string")
            return self.df.filter(F.upper(label).isin(*HIGH)).select(*shown, label.alias("target_value"), F.lit(None).cast("double").alias("bound"), F.lit("").alias("flags"))
        numbers = self.df.withColumn("__y", _number(t.column))
        limits = values_at(numbers, "__y", {"bound": lambda n: F.ceil(n * 0.75) - 1})
        column = {r: R.column_of(self.df.columns, r) for r in ("DTI", "CURRENT_DELINQUENCY", "DELINQUENCIES_12M", "CREDIT_RATING")}
        if column["DTI"]:
            scale = self.df.agg(F.when(F.max(_number(column["DTI"])) > 1, DTI_PERCENT).otherwise(DTI_SHARE).cast("double").alias("__dti"))
            limits = limits.crossJoin(F.broadcast(scale))
        rules = {"DTI": lambda c: _number(c) >= F.col("__dti"), "CURRENT_DELINQUENCY": lambda c: _number(c) > 0, "DELINQUENCIES_12M": lambda c: _number(c) > 0, "CREDIT_RATING": lambda c: _number(c) < RATING_BELOW}
        flags = [F.when(rules[r](c), F.lit(r)) for r, c in column.items() if c]
        joined = F.array_join(F.array_compact(F.array(*flags)), ",") if flags else F.lit("")
        return numbers.join(F.broadcast(limits)).filter("__y >= bound").select(*shown, F.col("__y").cast("string").alias("target_value"), "bound", joined.alias("flags"))

