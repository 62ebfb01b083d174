"""Bloom filters as tables of set bits."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, functions as F


def sizing(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes for so many items and such a rate of false positives."""
    if capacity <= 0:
        raise ValueError("capacity must be above 0")
    if not 0 < error < 1:
        raise ValueError("error rate must lie between 0 and 1")
    m = int(-capacity * math.log(error) / math.log(2) ** 2)
    return max(1, m), max(1, int(m / capacity * math.log(2)))


def positions(item: Column, m: int, k: int) -> Column:
    """The k bits of an item: MD5 of its bytes followed by the big-endian hash number, modulo m (below 2**31)."""
    out = []
    for i in range(k):
        digest = F.md5(F.concat(F.encode(item, "UTF-8"), F.lit(bytearray(struct.pack(">I", i)))))
        r = F.lit(0).cast("long")
        for w in range(4):
            word = F.conv(F.substring(digest, 8 * w + 1, 8), 16, 10).cast("long")
            r = F.pmod(r * F.lit(1 << 32) + word, F.lit(m))
        out.append(r)
    return F.array(*out)


def false_positive_rate(items: Column, m: int, k: int) -> Column:
    return F.when(items == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-F.lit(float(k)) * items / m), F.lit(k)))


def bits(df: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """The set bits of all items: (bit)."""
    return df.select(F.explode(positions(F.col(item), m, k)).alias("bit")).distinct()


def contained(df: DataFrame, item: str, filter_bits: DataFrame, m: int, k: int) -> DataFrame:
    """The rows all of whose bits are set. Bits are joined, not broadcast, so the filter may be of any size."""
    probe = df.select(item).distinct().select(item, F.explode(F.array_distinct(positions(F.col(item), m, k))).alias("bit"))
    found = probe.join(filter_bits.withColumn("_set", F.lit(True)), "bit", "left").groupBy(item).agg(F.count("*").alias("_n"), F.count("_set").alias("_hit"))
    return df.join(found.filter("_n = _hit").select(item), item, "left_semi")


def statistics(df: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """(items, bits_set, fill_ratio, false_positive_rate) of a filter of all items."""
    b = bits(df, item, m, k).agg(F.count("*").alias("bits_set"))
    n = df.agg(F.count(item).alias("items"))
    return n.crossJoin(b).select("items", "bits_set", F.round(F.col("bits_set") / m, 8).alias("fill_ratio"), F.round(false_positive_rate(F.col("items"), m, k), 8).alias("false_positive_rate"))
