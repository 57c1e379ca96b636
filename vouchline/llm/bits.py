"""A set of 64-bit hashes as a bit array of fixed size: it names all of them, and some others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**26 bits, 8 MB, whatever the input.
_BITS = 26


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """The array for the hashes (bigint) in a column; at most 2**20 rows reach the driver."""
    word, bit = F.shiftrightunsigned(column, 64 - (_BITS - 6)).cast("int"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, 20) & 63 AS int))")
    rows = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return bits.view(np.uint64)


def fits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (64 bits, signed or not) may be in the set."""
    h = hashes.view(np.uint64)
    return (bits[(h >> np.uint64(64 - (_BITS - 6))).astype(np.int64)] >> ((h >> np.uint64(20)) & np.uint64(63))) & np.uint64(1) > 0
