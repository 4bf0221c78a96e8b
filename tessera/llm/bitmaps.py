"""A set of hashes as a bitmap of fixed size: a filter without false negatives that any executor can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 32768  # bits of one of Spark's bitmap rows


def build(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of 2**``bits`` bits (at least ``ROW``) as bytes. Spark makes its rows; at most 2**bits / 8 bytes reach the driver,
    however many hashes there are. The more hashes, the more others pass too; the size is a parameter for that."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    rows = hashes.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).toLocalIterator():
        out[(r.k - 1) * ROW // 8: r.k * ROW // 8] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned 64-bit) may be in the set."""
    bits = int(len(bitmap) * 8).bit_length() - 1
    place = hashes >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
