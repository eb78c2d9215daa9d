"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Everything is built from DataFrame functions.

1. Base identifiers (email, ip, card, phone) are found with regular expressions
   and checked (number ranges, digit counts, Luhn).  Positions come from splitting
   the text by the same expression: pieces and matches alternate.
2. Identifier-like tokens outside of base identifiers are candidates.  Base
   identifiers are the seed instances.
3. The words to the left and to the right of an instance form lexical patterns.
   Patterns and instances make a bipartite graph whose scores are propagated for
   ``ROUNDS`` rounds: a pattern scores by the mean confidence of its instances, an
   instance by the noisy-or of its patterns; seeds keep confidence 1.
4. Patterns above ``ACCEPT`` with at least ``SUPPORT`` distinct seeds discover the
   candidates that stand in them and have the shape of the pattern's kind.
5. What they discover seeds the next turn: 3 and 4 are repeated until a turn
   discovers nothing new.

Regular expressions use possessive runs and start only where a run starts or the
last match ended, so that matching is linear in the text and keeps the leftmost
non-overlapping matches of the plain expressions.  Sequences over the matches of
one text are built in chunks, so a text of very many matches costs little more
than its length.

Defined results: null text counts as empty; a row with a null id is reported by
itself; rows that repeat an id are each reported; ties in confidence do not
matter, as thresholds alone decide; a candidate may be discovered as several
kinds and then has a span of each; an empty table gives no rows; ``find`` ignores
other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 0.9
SUPPORT = 5
#: Shares that the rows of one pattern or instance are dealt into.
SHARES = 16
#: Items of one chunk of a sequence.
CHUNK = 256

#: Equal in matches to the plain expressions, but linear on long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Tokens that hold a digit, with digit groups after single spaces, or an address
#: without a dotted domain.
_CANDIDATE = r"(?<![\p{L}\p{N}@._+-])(?:[A-Za-z._+-]*+[0-9][A-Za-z0-9._+-]*+(?:\x20[(]?[0-9][0-9().-]*+)*+|[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9.-]*\.[A-Za-z0-9]))"
#: Stands for a character of a base identifier where candidates are looked for.
_TAKEN = "\ue000"

_MATCH = "struct<start:bigint,end:bigint,value:string,left:string,right:string>"
_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn check of a digit string."""
    backwards = F.split(F.reverse(digits), "")
    value = F.transform(backwards, lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") * 2 / 10).cast("int"))))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's expression counts."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value evaluated once; lambdas evaluate anew for each item."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _chunks(items: Column) -> Column:
    """Consecutive slices of at most ``CHUNK`` items; the items are not empty."""

    def cut(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))

    return _let(items, cut)


def _before_each(values: Column, add: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What ``add`` makes of the values before each one, from 0 on.

    A fold copies its state in each step, so states stay as short as a chunk; the
    values before a chunk come from the same rule over the chunks.
    """
    zero = F.lit(0).cast("long")

    def grown(part: Column, first: Column) -> Column:
        more = F.aggregate(part, F.array(first), lambda done, x: F.concat(done, F.array(add(F.element_at(done, -1), x))))
        return F.slice(more, F.lit(1), F.size(part))

    if not levels:
        return _let(values, lambda xs: grown(xs, zero))

    def over(parts: Column) -> Column:
        firsts = _before_each(F.transform(parts, lambda c: F.aggregate(c, zero, add)), add, levels - 1)
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), firsts.alias("first")), lambda z: grown(z["part"], z["first"])))

    return _let(_chunks(values), over)


def _found(df: DataFrame, text: str, out: str, expression: str, may: Column) -> DataFrame:
    """``df`` with the matches in order: start, end (code points, end exclusive),
    value, and the text between the neighbouring matches on either side."""
    pieces, values = f"_pieces_{out}", f"_values_{out}"
    df = df.withColumns(
        {
            values: F.when(may, F.regexp_extract_all(F.col(text), F.lit(f"({expression})"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)")),
            pieces: F.when(may, F.split(F.col(text), expression, -1)).otherwise(F.array(F.lit(""))),
        }
    )
    n = F.size(values)
    pairs = F.arrays_zip(F.col(values).alias("value"), F.slice(pieces, F.lit(1), n).alias("left"), F.slice(pieces, F.lit(2), n).alias("right"))
    lengths = F.transform(pairs, lambda x: (F.char_length(x["left"]) + F.char_length(x["value"])).cast("long"))
    df = df.withColumns({f"_pairs_{out}": pairs, f"_at_{out}": F.when(n > 0, _before_each(lengths, lambda a, x: a + x))})

    def match(z: Column) -> Column:
        x = z["x"]
        start = z["at"] + F.char_length(x["left"])
        return F.struct(start.alias("start"), (start + F.char_length(x["value"])).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))

    some = F.transform(F.arrays_zip(F.col(f"_pairs_{out}").alias("x"), F.col(f"_at_{out}").alias("at")), match)
    return df.withColumn(out, F.when(n > 0, some).otherwise(F.expr(f"cast(array() as array<{_MATCH}>)"))).drop(values, pieces, f"_pairs_{out}", f"_at_{out}")


def _ranked(matches: str, rank: int, kind: str) -> Column:
    """Counting matches of a kind, as structs that sort by start, then kind."""
    good = F.filter(matches, lambda m: _holds(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), _patterns(m["left"], m["right"]).alias("patterns")))


def _with_base(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: start, rank, kind, end, value and patterns of the base
    identifiers, by start, then kind.  Row-wise."""
    body = F.col(text)
    number = body.rlike("[0-9]")
    expressions = {"email": (_EMAIL, body.contains("@")), "ip": (_IP, body.rlike(r"[0-9]\.[0-9]")), "card": (_CARD, number), "phone": (_PHONE, body.contains("+"))}
    parts = []
    for rank, kind in enumerate(KINDS):
        df = _found(df, text, f"_{kind}", *expressions[kind])
        parts.append(_ranked(f"_{kind}", rank, kind))
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(*[f"_{kind}" for kind in KINDS])


def base_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, key, base (array of start, rank, kind, end, value, patterns) and candidates.

    ``key`` names a row among others; rows equal in id and text share it.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with_base(rows.withColumn("key", row_key(F.col("id"), F.col("text"))), "text", "base")
    # Base identifiers are no candidates, nor parts of any.
    rows = rows.withColumn("text", F.when(F.size("base") > 0, replaced(F.col("text"), F.col("base"), lambda s, fresh, n: F.repeat(F.lit(_TAKEN), n))).otherwise(F.col("text")))
    rows = _found(rows, "text", "_candidates", _CANDIDATE, F.col("text").rlike("[0-9]") | F.col("text").contains("@"))
    free = F.filter("_candidates", lambda c: (F.length(_digits(c["value"])) >= 5) | c["value"].contains("@"))
    candidates = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), _patterns(c["left"], c["right"]).alias("patterns")))
    return rows.select("id", "key", "base", candidates.alias("candidates"))


def _norm(value: Column) -> Column:
    """One spelling of an instance: digits alone where it has many, else lower case."""
    digits = _digits(value)
    return F.when(F.length(digits) >= 7, digits).otherwise(F.lower(value))


def _shape(kind: Column, value: Column) -> Column:
    """Whether a candidate looks like the kind, without passing its base rules."""
    n = F.length(_digits(value))
    plain = value.rlike(r"^[0-9().\x20-]+$")
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike(r"^[0-9]+(?:[.-][0-9]+){3}$"))
        .when(kind == "card", plain & n.between(12, 19))
        .when(kind == "phone", plain & n.between(7, 15))
        .otherwise(False)
    )


_WORD, _SIGNS = r"[\p{L}\p{N}_]++", r"[^\p{L}\p{N}_]"


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of a context, with signs: the last word on the left, the last
    two, the last with the first on the right, and the first two on the right.

    The left side is read backwards from the instance, so a long context costs no
    more than the words that are used.
    """
    back = F.reverse(left)
    one = F.regexp_extract(back, rf"\A({_SIGNS}+{_WORD})", 1)
    two = F.regexp_extract(back, rf"\A({_SIGNS}+{_WORD}{_SIGNS}+{_WORD})", 1)
    next_one = F.regexp_extract(right, rf"\A({_SIGNS}+{_WORD})", 1)
    next_two = F.regexp_extract(right, rf"\A({_SIGNS}+{_WORD}{_SIGNS}+{_WORD})", 1)
    named = [
        F.when(one != "", F.concat(F.reverse(one), F.lit("*"))),
        F.when(two != "", F.concat(F.reverse(two), F.lit("*"))),
        F.when((one != "") & (next_one != ""), F.concat(F.reverse(one), F.lit("*"), next_one)),
        F.when(next_two != "", F.concat(F.lit("*"), next_two)),
    ]
    return F.array_compact(F.array(*[F.lower(F.regexp_replace(p, r"\s+", " ")) for p in named]))


def _occurrences(spans: DataFrame) -> DataFrame:
    """One row for each instance and pattern: key, kind (null for candidates), place, value."""

    def of(column: str, kind: Column) -> DataFrame:
        x = F.col("x")
        return spans.select("key", F.explode(column).alias("x")).select("key", kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _norm(x["value"]).alias("instance"), F.explode(x["patterns"]).alias("pattern"))

    return of("base", F.col("x.kind")).unionByName(of("candidates", F.lit(None).cast("string")))


def accepted_patterns(edges: DataFrame, seeds: DataFrame, *, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """kind and pattern of high confidence, scored over the pattern-instance graph.

    ``edges``: distinct pattern and instance.  ``seeds``: distinct kind and instance.
    """
    seeded = edges.join(seeds, "instance").select("kind", "pattern", "instance")
    induced = seeded.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
    # Every distinct instance of an induced pattern, seed of the kind or not.
    graph = scratch.dealt(edges, induced, ["pattern"], "instance", SHARES).join(seeds.withColumn("seed", F.lit(True)), ["kind", "instance"], "left")
    graph = scratch.cut(graph.select("kind", "pattern", "instance", F.coalesce("seed", F.lit(False)).alias("seed")))
    confidence = graph.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("c"))
    patterns = None
    for _ in range(rounds):
        # Sums of shares first: a pattern may hold very many instances.
        patterns = graph.join(confidence, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.avg("c").alias("score"))
        spread = scratch.dealt(graph, patterns, ["kind", "pattern"], "instance", SHARES)
        doubt = F.exp(F.sum(F.ln(F.greatest(1 - F.col("score") * F.col("score"), F.lit(1e-12)))))
        confidence = scratch.cut(spread.groupBy("kind", "instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("c")))
    return patterns.filter(F.col("score") >= accept).select("kind", "pattern")


def discovered(spans: DataFrame, **options) -> DataFrame | None:
    """key, start, kind and end of the candidates that accepted patterns discover.

    Instances discovered in one turn are seeds of the next; the turns end when
    nothing new is discovered, as instances are finite.  None if nothing ever is.
    """
    occurrences = _occurrences(spans)
    edges = scratch.cut(occurrences.select("pattern", "instance").distinct())
    seeds = scratch.cut(occurrences.filter("kind is not null").select("kind", "instance").distinct())
    free = occurrences.filter("kind is null").drop("kind")
    candidates = scratch.cut(free.select("pattern", "instance", "value").distinct())
    patterns, found = None, None
    while True:
        turn = accepted_patterns(edges, seeds, **options)
        patterns = scratch.cut(turn if patterns is None else patterns.unionByName(turn).distinct())
        shaped = scratch.dealt(candidates, patterns, ["pattern"], "value", SHARES).filter(_shape(F.col("kind"), F.col("value")))
        new = scratch.cut(shaped.select("kind", "instance").distinct().join(seeds, ["kind", "instance"], "left_anti"))
        if new.isEmpty():
            break
        found = True
        seeds = scratch.cut(seeds.unionByName(new))
    if not found:
        # Values of known seeds may still stand in accepted patterns as candidates.
        if scratch.dealt(candidates, patterns, ["pattern"], "value", SHARES).filter(_shape(F.col("kind"), F.col("value"))).isEmpty():
            return None
    hits = scratch.dealt(free, patterns, ["pattern"], "key", SHARES).filter(_shape(F.col("kind"), F.col("value")))
    return hits.select("key", "start", "kind", "end").distinct()


def _added(spans: DataFrame, **options) -> DataFrame | None:
    """key and added (sorted spans) of the rows in which something was discovered."""
    found = discovered(spans, **options)
    if found is None:
        return None
    ranks = F.create_map(*[F.lit(x) for rank, kind in enumerate(KINDS) for x in (kind, rank)])
    return found.groupBy("key").agg(F.collect_set(F.struct("start", ranks[F.col("kind")].alias("rank"), "kind", "end")).alias("added"))


def _narrow(base: Column) -> Column:
    return F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["kind"].alias("kind"), b["end"].alias("end")))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, key, base and spans of every row: structs of start, rank, kind and end in order."""
    spans = scratch.cut(base_spans(docs, doc_id=doc_id, text=text))
    added = _added(spans, **options)
    kept = spans.select("id", "key", _narrow(F.col("base")).alias("base"))
    if added is None:
        return kept.withColumn("spans", F.col("base"))
    nothing = F.expr(f"cast(array() as array<{_SPAN}>)")
    joined = kept.join(added, "key", "left")
    return joined.select("id", "key", "base", F.array_sort(F.concat("base", F.coalesce("added", nothing))).alias("spans"))


def mask(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind; null texts stay.

    Base spans are found in the rows themselves; whole texts are joined to what was
    discovered only if anything was.
    """
    added = _added(scratch.cut(base_spans(docs, doc_id=doc_id, text=text)), **options)
    # The input's columns stand in one struct, so none of them can meet a helper's name.
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"))
    before = F.col("row")[text]
    rows = _with_base(packed.withColumn("_text", F.coalesce(before, F.lit(""))), "_text", "_base")
    spans = _narrow(F.col("_base"))
    if added is not None:
        rows = rows.withColumn("_key", row_key(F.col("row")[doc_id], F.col("_text"))).join(added.select(F.col("key").alias("_key"), F.col("added").alias("_added")), "_key", "left")
        spans = F.array_sort(F.concat(spans, F.coalesce("_added", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    rows = rows.withColumn("_spans", spans)
    after = F.when(before.isNull() | (F.size("_spans") == 0), before).otherwise(masked(F.col("_text"), F.col("_spans")))
    return rows.select(*[(after if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def row_key(doc_id: Column, text: Column) -> Column:
    """The key that ``find`` gives a row."""
    return F.sha2(F.concat_ws("\u0000", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256)


def replaced(text: Column, spans: Column, mark: Callable[[Column, Column, Column], Column]) -> Column:
    """``text`` with each of some spans replaced by ``mark`` of the span, whether it
    starts behind the spans before it, and how many characters it covers beyond them.

    Each chunk of spans cuts its stretch of the text once and counts from there.
    """
    reached = _before_each(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    chunks = _chunks(F.arrays_zip(spans.alias("s"), reached.alias("at")))
    zero = F.lit(0).cast("long")

    def part(chunk: Column) -> Column:
        first = F.get(chunk, F.lit(0))["at"]
        end = F.array_max(F.transform(chunk, lambda z: F.greatest(z["at"], z["s"]["end"])))
        stretch = F.substring(text, (first + 1).cast("int"), (end - first).cast("int"))

        def one(z: Column, window: Column) -> Column:
            s, at = z["s"], z["at"]
            before = F.substring(window, (at - first + 1).cast("int"), F.greatest(zero, s["start"] - at).cast("int"))
            covered = F.greatest(zero, s["end"] - F.greatest(at, s["start"]))
            return F.concat(before, mark(s, s["start"] >= at, covered.cast("int")))

        return F.array_join(_let(stretch, lambda window: F.transform(chunk, lambda z: one(z, window))), "")

    reach = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.array_join(F.transform(chunks, part), ""), F.substring(text, (reach + 1).cast("int"), F.lit(2147483647)))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its kind."""
    return F.when(F.size(spans) == 0, text).otherwise(replaced(text, spans, lambda s, fresh, _: F.when(fresh, F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))))
