"""A bit filter of 64-bit hashes, which tasks use to skip rows early.

Its size is bounded whatever the input: it has eight bits for each bit that is set, and
``2 ** BITS`` at most.  A fuller filter lets more rows through that later exact steps
drop; it never loses one.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the number of bits, at least and at most: 8 KB to 32 MB.
LEAST_BITS, BITS = 16, 28
#: A second place in the filter, from the same hash.
_SHIFT = 29


def built(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """The filter of a long column, broadcast as bytes; two bits a hash.

    Bits meet in Spark as words of 64; the driver gets ``2 ** (bits - 6)`` words at most.
    Places are the low bits of a hash, so a filter is halved by laying one half on the
    other.
    """
    mask = (1 << bits) - 1
    places = F.array(F.expr(f"`{column}` & {mask}L"), F.expr(f"shiftrightunsigned(`{column}`, {_SHIFT}) & {mask}L"))
    words = hashes.select(F.explode(places).alias("h")).groupBy(F.expr("h div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("bits"))
    found = words.toArrow()
    at, values = found.column("word").to_numpy(), found.column("bits").to_numpy().view(np.uint64)
    wanted = int(np.bitwise_count(values).sum()) * 8
    size = max(min(LEAST_BITS, bits), min(bits, wanted.bit_length()))
    held = np.zeros(1 << (size - 6), np.uint64)
    np.bitwise_or.at(held, at & (len(held) - 1), values)
    return hashes.sparkSession.sparkContext.broadcast(held.view(np.uint8))


def maybe(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which uint64 hashes the filter may hold."""
    mask = np.uint64(len(held) * 8 - 1)

    def set_at(h: np.ndarray) -> np.ndarray:
        return ((held[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1) > 0

    return set_at(hashes & mask) & set_at((hashes >> np.uint64(_SHIFT)) & mask)
