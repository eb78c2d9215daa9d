"""One Aho-Corasick automaton over word sequences.

A sequence is stored between single spaces, so a match covers whole words and
sequences may overlap.  An automaton is built from about ``MAX_BYTES`` of patterns at
most; callers split a larger pattern set and scan once a shard.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np

#: An automaton takes some 45 times the memory of its text, once in each Python worker.
MAX_BYTES = 4 << 20

_built: dict[str, ahocorasick.Automaton] = {}


def key_of(patterns: list[tuple[str, object]]) -> str:
    return hashlib.sha256(repr(patterns).encode()).hexdigest()


def automaton(key: str, patterns: list[tuple[str, object]]) -> ahocorasick.Automaton:
    """Built once in each Python worker; equal patterns must be merged before."""
    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for text, value in patterns:
            found.add_word(text, (text.count(" ") - 1, value))
        found.make_automaton()
        _built[key] = found
    return _built[key]


def places(matcher: ahocorasick.Automaton, padded_text: str) -> list[tuple[int, int, object]]:
    """(first word, word count, value) of every occurrence, in order of their ends."""
    hits = list(matcher.iter(padded_text)) if padded_text and len(matcher) else []
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(padded_text.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in hits])
    return [(int(e) - n, n, value) for e, (_, (n, value)) in zip(ends, hits)]
