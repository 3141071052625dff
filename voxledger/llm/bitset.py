"""Bit sets of 64-bit hashes with a fixed upper size, to keep rows without a partner out of shuffles.

They only ever pass too much: whatever passes is still joined on the full key. Past the upper size
more rows pass, and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # 128 KB to 16 MB


def bit_set(hashes: DataFrame, n: int, bits_each: int) -> np.ndarray:
    """Bytes of the set of column ``h``; gathered as bitmaps of 4 KB, MOST_BITS in all at the most."""
    size = LEAST_BITS
    while size < min(MOST_BITS, n * bits_each):
        size *= 2
    index = F.shiftrightunsigned("h", 64 - (size.bit_length() - 1))
    chunks = hashes.select(index.alias("i")).groupBy(F.floor(F.col("i") / 32768).alias("k"))
    out = np.zeros(size // 8, np.uint8)
    for row in chunks.agg(F.bitmap_construct_agg(F.col("i") % 32768).alias("bits")).collect():
        out[row["k"] * 4096 : (row["k"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the set."""
    index = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(index >> np.uint64(3)).astype(np.int64)] >> (index & np.uint64(7)).astype(np.uint8)) & 1 > 0
