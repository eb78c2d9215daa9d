"""One text for a value, whatever order its keys had or partitions held it: canonical JSON.

Keys are sorted at every depth by code points, there is no white space, numbers have one
form, and what JSON lacks (null, NaN, infinite values) is ``null``.  Dates and times are
ISO texts in the session's zone; other types are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def number_text(c: Column) -> Column:
    """A double in plain digits, from 1e21 and below 1e-6 with an exponent; -0 is 0."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    text = c.cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    sign, first, e = part(1), part(2), part(4).cast("int")
    rest = F.regexp_replace(part(3), "0+$", "")
    digits = F.concat(first, rest)
    spread = F.when(e >= 21, F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e+"), e.cast("string")))
    spread = spread.when(e >= F.length(rest), F.rpad(digits, e + 1, "0"))
    spread = spread.when(e > 0, F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    spread = spread.when(e >= -6, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    spread = spread.otherwise(F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), e.cast("string")))
    return F.when(whole, F.floor(c).cast("bigint").cast("string")).when(text.contains("E"), F.concat(sign, spread)).otherwise(text)


def canonical(c: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of the given type."""
    if isinstance(kind, T.StringType):
        out = quoted(c)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        out = F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(number_text(x))
    elif isinstance(kind, T.DecimalType):
        out = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, T.DateType):
        out = quoted(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pairs = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.alias("k"), F.element_at(c, k).alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(":"), canonical(p["v"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def row_json(df: DataFrame, *columns: str) -> Column:
    """The canonical JSON object of a row's columns (all, if none is named)."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    return canonical(F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields]), T.StructType(fields))


def digest_of(text: Column) -> Column:
    """Aggregate: count and sum of 60-bit hashes of texts, the same for any order."""
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.concat(F.count(text).cast("string"), F.lit("-"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string"))


def ordered_digest_of(position: Column, text: Column) -> Column:
    """Aggregate: as ``digest_of``, but texts count with their places."""
    return digest_of(F.concat(position.cast("string"), F.lit(":"), text))
