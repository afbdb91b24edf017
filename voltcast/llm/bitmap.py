"""Fixed-size bitmap of 64-bit keys, to let through nearly only rows that a later exact join keeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """2**BITS bits (2 MB) with the slot of every key set; built by bitwise-or in Spark, at most 2**(BITS-6) words reach the driver."""
    slot = F.shiftrightunsigned(column, 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - BITS}) & 63 as int))")
    parts = keys.select(F.shiftright(slot, 6).cast("int").alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect()
    words = np.zeros(1 << (BITS - 6), np.int64)
    for i, b in parts:
        words[i] = b
    return words.view(np.uint8)


def present(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the keys whose slot is set."""
    slot = keys >> np.uint64(64 - BITS)
    return np.flatnonzero((table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
