"""License scans: Aho-Corasick for tags and notices, shunting-yard for expressions.

One automaton over normalised words finds the fixed base phrases, further notice
phrases and the identifier tag ``spdx license identifier``.  After a tag the rest
of the original line is read as a licence expression: identifiers joined by AND,
OR and WITH, with brackets.  A shunting-yard parser turns it into postfix order,
which is evaluated to the identifiers it names, a normal form and whether every
choice is permissive.

Defined results: null or empty text has no words and score 0; a damaged
expression adds only the identifiers read before the damage; repeated rows are
each reported; an empty table gives no rows; other columns are passed through,
and one named like the output is replaced.  ``permissive`` is null without an
expression, else whether every expression of the text has a permissive choice; an
exception after WITH stays in the expression and is no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import phrases
from larkspur.llm.words import WORD, binary_texts, padded, words_of

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices.  A longer phrase may hold a shorter one.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "boost software license": "bsl",
    "eclipse public license": "epl",
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "unlicense", "0bsd", "zlib", "bsl", "public-domain", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("permissive", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_KIND = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")] + [(n, pa.list_(pa.string())) for n in ("base_labels", "labels", "expressions")] + [("permissive", pa.bool_()), ("score", pa.float64())]
)


def postfix(text: str) -> list[str]:
    """Postfix order of the longest well-formed expression at the start of ``text``."""
    best: list[str] = []
    out: list[str] = []
    stack: list[str] = []
    want_operand = True
    end = 0

    def finished() -> list[str] | None:
        return None if "(" in stack else out + stack[::-1]

    for m in _TOKEN.finditer(text):
        token, gap = m.group(), text[end : m.start()]
        word = token.lower()
        if gap.strip():
            break
        if want_operand:
            if token == "(":
                stack.append(token)
            elif word in PRECEDENCE or token == ")":
                break
            else:
                out.append(token)
                want_operand = False
        elif word in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            want_operand = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        end = m.end()
        if not want_operand and (done := finished()):
            best = done
    return best


def evaluate(order: list[str]) -> tuple[str, frozenset[str], bool]:
    """(normal form, identifiers, usable permissively) of a postfix expression."""
    stack: list[tuple[str, frozenset[str], bool]] = []
    for token in order:
        if token not in PRECEDENCE:
            name = token.rstrip(".+").lower() if token.endswith(".") else token.lower()
            stack.append((name, frozenset([name]), name.startswith(PERMISSIVE)))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append((f"{a[0]} with {b[0]}", a[1], a[2]))
        else:
            form = f" {token} ".join(sorted((a[0], b[0])))
            stack.append((f"({form})", a[1] | b[1], (a[2] or b[2]) if token == "or" else (a[2] and b[2])))
    return stack[0] if stack else ("", frozenset(), False)


def patterns() -> list[tuple[str, object]]:
    found: dict[str, list[tuple[str, str]]] = {}
    for role, table in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in table.items():
            found.setdefault(padded(words_of(phrase.encode())), []).append((role, label))
    return list(found.items())


def scan_text(text: bytes | None, matcher) -> dict:
    words = words_of(text)
    hits = phrases.places(matcher, padded(words))
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "expressions": [], "permissive": None, "score": 0.0}
    if not hits:
        return row
    base = sorted((first, label) for first, _, roles in hits for role, label in roles if role == "base")
    notices = {label for *_, roles in hits for role, label in roles if role == "notice"}
    tags = [first + n - 1 for first, n, roles in hits for role, _ in roles if role == "tag"]
    expressions, named, free = [], set(), []
    if tags:
        original = text.decode("utf-8", "replace")
        ends = [m.end() for m in WORD.finditer(original)]
        for last in tags:
            line = original[ends[last] :].lstrip(":= \t").partition("\n")[0]
            if order := postfix(line):
                form, ids, permissive = evaluate(order)
                expressions.append(form)
                free.append(permissive)
                named |= ids
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *notices, *named})
    kinds = len(labels) + 2 * len(expressions)
    return row | {"n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None, "base_labels": base_labels, "labels": labels, "expressions": sorted(set(expressions)), "permissive": all(free) if free else None, "score": kinds / (kinds + 1.0)}


def _scan(batches: Iterator[pa.RecordBatch], text: str, out: str) -> Iterator[pa.RecordBatch]:
    table = patterns()
    matcher = phrases.automaton(phrases.key_of(table), table)
    for batch in batches:
        report = pa.array([scan_text(x, matcher) for x in binary_texts(batch.column(batch.schema.get_field_index(text)))], _KIND)
        keep = [i for i, name in enumerate(batch.schema.names) if name != out]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), report], [*(batch.schema.names[i] for i in keep), out])


def scan(docs: DataFrame, *, text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with a struct column ``out``; the score is 0 without any finding."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, REPORT)])

    def task(batches):
        return _scan(batches, text, out)

    return docs.mapInArrow(task, schema)
