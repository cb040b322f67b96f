"""A Bloom filter of fixed size, built in the JVM by Spark's own aggregate of hash bits, to thin one side of a join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES, BITS_PER_KEY, LEAST_BITS = 4, 9.59, 64


def bits_for(keys: int) -> int:
    return max(LEAST_BITS, math.ceil(keys * BITS_PER_KEY))


def filter_bits(df: DataFrame, key: str, keys: int) -> DataFrame:
    """The set bits of a filter for about ``keys`` keys, as rows: distributed, whatever its size."""
    size = bits_for(keys)
    return df.select(F.explode(F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(size)) for i in range(HASHES)))).alias("bit")).distinct()


def might_contain(df: DataFrame, key: str, small: DataFrame, small_key: str, limit: int = 1_000_000) -> DataFrame:
    """Rows whose key may be in the smaller side; all rows if that side has more than ``limit`` distinct keys, where thinning doesn't pay.

    Never drops a row that has a partner.  Null keys count as keys.
    """
    n = small.select(small_key).distinct().limit(limit + 1).count()
    if n > limit:
        return df
    size = bits_for(n)
    rows = filter_bits(small, small_key, n).collect()
    packed = bytearray(-(-size // 8))
    for r in rows:
        packed[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    held = F.lit(bytes(packed))
    at = lambda i: F.pmod(F.xxhash64(key, F.lit(i)), F.lit(size))
    byte = lambda b: F.conv(F.hex(F.substring(held, (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    test = F.lit(True)
    for i in range(HASHES):
        test &= F.getbit(byte(at(i)), F.pmod(at(i), F.lit(8)).cast("int")) == 1
    return df.where(test)
