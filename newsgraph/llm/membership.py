"""A fixed-size bit table of hashes: says "perhaps in the set" or "surely not", never misses a member.

Its size is a parameter and does not grow with the data, so it can be broadcast safely. A full table answers
"perhaps" more often, which costs work downstream and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = 32768  # bits in one row of bitmap_construct_agg


class BitTable:
    def __init__(self, shared: Broadcast, bits: int):
        self.shared, self.bits = shared, bits

    def perhaps(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        table = self.shared.value
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_table(members: DataFrame, column: str, bits: int) -> BitTable:
    """``column`` is a 64-bit hash; ``bits`` is a power of two. At most bits / 8 bytes come to the driver."""
    at = F.col(column).bitwiseAND(bits - 1)
    rows = (
        members.where(F.col(column).isNotNull())
        .select(F.shiftright(at, 15).alias("row"), (at % _ROW).alias("bit"))
        .groupBy("row")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        .toArrow()
    )
    table = np.zeros(bits // 8, np.uint8)
    for row, bitmap in zip(rows["row"].to_pylist(), rows["bitmap"].to_pylist(), strict=True):
        part = np.frombuffer(bitmap, np.uint8)
        table[row * (_ROW // 8) : row * (_ROW // 8) + len(part)] = part
    return BitTable(members.sparkSession.sparkContext.broadcast(table), bits)
