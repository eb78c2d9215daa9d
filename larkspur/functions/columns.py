"""Scalar rules shared by the operators, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375

#: Service level and its one-sided normal quantile.
Z_TABLE = ((0.9, 1.2816), (0.95, 1.6449), (0.975, 1.96), (0.98, 2.0537), (0.99, 2.3263), (0.995, 2.5758))


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def numeric_cell(c: Column) -> Column:
    """A cell as a finite number, or null: white space of any kind is dropped."""
    text = F.regexp_replace(c.cast("string"), r"(?U)\s", "")
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, text.try_cast("double"))


def z_score(level: Column) -> Column:
    """Linear between the table's rows, constant outside of them."""
    out = F.when(level <= Z_TABLE[0][0], F.lit(Z_TABLE[0][1]))
    for (a, za), (b, zb) in zip(Z_TABLE, Z_TABLE[1:]):
        out = out.when(level <= b, F.lit(za) + F.lit(zb - za) * ((level - F.lit(a)) / F.lit(b - a)))
    return out.otherwise(F.lit(Z_TABLE[-1][1]))


def month_add(month: Column, n: Column | int) -> Column:
    """'yyyy-MM' plus n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero after scaling in doubles, as SQL twins round; ``F.round`` goes by a
    number's decimal text, so 2912.1749999999997, whose hundredfold is 291217.5, differs."""
    scaled = c * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**digits)).otherwise(c)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value evaluated once, where a lambda would repeat it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over a group; 0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def bounded_ids(rows: DataFrame, column: str, order: list[str], most: int = 12) -> DataFrame:
    """ids: the number of ids, the first of them, and how many more there are."""
    first = rows.orderBy(*order).limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_id")))), lambda x: x["_id"]).alias("first"))
    total = rows.agg(F.count(column).alias("n"))
    shown = F.when(F.size("first") > 0, F.concat(F.lit(" · "), F.array_join("first", ", "))).otherwise("")
    more = F.when(F.col("n") > most, F.concat(F.lit(" … (ещё "), (F.col("n") - most).cast("string"), F.lit(")"))).otherwise("")
    return total.join(F.broadcast(first)).select(F.concat(F.col("n").cast("string"), F.lit(" ID"), shown, more).alias("ids"))


def percentage_change(before: Column, now: Column) -> Column:
    """Change as a fraction of the value before; 0 where that is 0."""
    return F.when(before == 0, 0.0).otherwise(F.try_divide(now - before, F.abs(before)))


def floor_quantile(sorted_values: Column, fraction: float) -> Column:
    """Element floor((n-1)f) of a sorted array."""
    return F.element_at(sorted_values, (F.floor((F.size(sorted_values) - 1) * F.lit(fraction)) + 1).cast("int"))


def header_key(c: Column) -> Column:
    """Lower case, one letter for yo, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.translate(c, " ", " ")), "ё", "е"), "[^a-zа-я0-9]+", " "))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of a text of the basic plane, in hex."""
    value = F.aggregate(F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long")), F.lit(2166136261).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(16777619).cast("long"), F.lit(4294967296)))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def url_component(c: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def formula_guard(c: Column) -> Column:
    """A quote before texts that a spreadsheet would run."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun after a number."""
    last, two = F.abs(n) % 10, F.abs(n) % 100
    return F.when(two.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def decimal_comma(c: Column) -> Column:
    """A number's text with a comma."""
    return F.replace(c.cast("string"), F.lit("."), F.lit(","))


#: Words that claim a cause.
CAUSAL = r"(?i)\b(causes?|caused|causing|proves?|proving|confirms?|guarantees?)\b"


def claims_cause(c: Column) -> Column:
    """Whether a text claims a cause, which no observed relation supports."""
    return F.coalesce(c.rlike(CAUSAL), F.lit(False))


def display_label(c: Column, known: dict[str, str] | None = None) -> Column:
    """A known label of an id, else the id with spaces and a capital."""
    plain = F.replace(c, F.lit("_"), F.lit(" "))
    pretty = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 2147483647))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in known.items() for x in item]), c), pretty) if known else pretty
