"""A membership filter, built in a shuffle and broadcast: two bits a member, some twelve bits of room for each.

It never misses a member; what it lets through wrongly must not change results. Its size follows the counted members
up to MOST_BITS (128 MB) and is that for any number beyond: it then lets more and more through, so that what it was to
save is done, and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 30


def build(members: DataFrame, column: str = "h"):
    """A broadcast of the filter's bytes for a column of 64-bit hashes of a table that was written out."""
    size = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(12 * members.count() + 1)))))
    low = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
    bit = F.explode(F.array(low, F.shiftrightunsigned(column, 64 - size)))
    words = members.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("one"))
    found = words.groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()  # 2^24 rows at most
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return members.sparkSession.sparkContext.broadcast(bits.tobytes())


def hits(table: bytes, h: np.ndarray) -> np.ndarray:
    """Which of these uint64 hashes may be members."""
    bits = np.frombuffer(table, np.uint64)
    size = len(bits).bit_length() + 5

    def on(bit: np.ndarray) -> np.ndarray:
        return (bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1

    return on((h & np.uint64((1 << size) - 1)).astype(np.int64)) & on((h >> np.uint64(64 - size)).astype(np.int64))
