"""Word normalisation on UTF-8 bytes.

``bytes.lower`` changes A-Z only, so lower-casing never alters other scripts.
"""

from __future__ import annotations

import re

import pyarrow as pa

#: Every byte outside ``[0-9A-Za-z\x80-\xFF]`` separates words.
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

#: The same words in text that is not lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; null or empty text has none."""
    return text.lower().translate(_TO_SPACE).split() if text else []


def padded(words: list[bytes]) -> str:
    """Words between single spaces, one character a byte, ready for matching."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def binary_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
