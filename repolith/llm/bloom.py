"""Bloom filters as small tables of 64-bit words, made and probed with DataFrame operations only.

A filter has at most ``bits / 64`` rows of two longs, so its size is bounded by a parameter (16 MB at the default)
whatever the input; that bound is what allows the broadcast. A filter that fills up costs speed, never results: every
row that it lets through is checked exactly afterwards. Rows that are probed have no columns of the names used here
(``__word``, ``__mask``, ``__position``, ``__maybe``): callers put a user's columns into one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits: at most 2**20 rows of 16 bytes.
MAX_BITS = 1 << 26


def filter_bits(rows: int, per_row: int = 64, most: int = MAX_BITS) -> int:
    """A power of two with ``per_row`` bits for each row, between 2**10 and ``most``."""
    return min(most, 1 << max(10, (max(rows, 1) * per_row - 1).bit_length()))


def position(hashed: Column, bits: int) -> Column:
    return F.pmod(hashed, F.lit(bits))


def packed(positions: DataFrame) -> DataFrame:
    """Rows (word, mask) from distinct ``position``s."""
    return positions.groupBy(F.shiftright("position", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(position & 63 as int))")).alias("mask")
    )


def repeated_filter(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """The filter of positions that two rows or more hit. Counts are summed before the shuffle."""
    return packed(
        hashes.select(position(F.col(column), bits).alias("position")).groupBy("position").count().filter("count > 1").select("position")
    )


def member_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """The filter of the positions of all non-null ``keys``."""
    return packed(keys.filter(F.col(column).isNotNull()).select(position(F.xxhash64(column), bits).alias("position")).distinct())


def flagged(rows: DataFrame, hashed: Column, table: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: whether the filter may hold ``hashed``. False is certain; null hashes are false."""
    at = F.col("__position")
    rows = rows.withColumn("__position", position(hashed, bits)).withColumn("__word", F.shiftright(at, 6))
    table = F.broadcast(table.select(F.col("word").alias("__word"), F.col("mask").alias("__mask")))
    hit = F.expr("(shiftright(__mask, cast(__position & 63 as int)) & 1) = 1")
    return rows.join(table, "__word", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__word", "__mask", "__position")


def semi_join(rows: DataFrame, keys: DataFrame, column: str, bits: int) -> DataFrame:
    """``rows`` whose ``column`` is among the distinct ``keys``: those that the filter excludes never shuffle."""
    maybe = flagged(rows, F.xxhash64(column), member_filter(keys, column, bits), bits, "__maybe").filter("__maybe").drop("__maybe")
    return maybe.join(keys.select(column).distinct(), column, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, column: str, bits: int) -> DataFrame:
    """``rows`` whose ``column`` is not among the distinct ``keys``: those that the filter excludes pass straight through."""
    split = flagged(rows, F.xxhash64(column), member_filter(keys, column, bits), bits, "__maybe")
    through = split.filter("not __maybe").drop("__maybe")
    checked = split.filter("__maybe").drop("__maybe").join(keys.select(column).distinct(), column, "left_anti")
    return through.unionByName(checked)
