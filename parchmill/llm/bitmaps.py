"""Bloom filters as tables of bitmaps, made and read with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits in one bitmap of the built-in bitmap functions.
PIECE_BITS = 32768

# A filter never exceeds 2^28 bits (32 MB to broadcast), whatever the number of
# rows. Beyond that it lets more rows through; it never loses one.
MOST_BITS = 1 << 28
BITS_PER_ROW = 16
PROBES = 2


def filter_bits(n_rows: int) -> int:
    bits = PIECE_BITS
    while bits < min(n_rows * BITS_PER_ROW, MOST_BITS):
        bits *= 2
    return bits


def cells(key: Column, bits: int) -> list[Column]:
    """The cells of a key, counted from 1 as the bitmap functions do."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) + 1 for i in range(PROBES)]


def repeated(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Filter of the keys that may occur more than once: bits of cells hit twice or more."""
    hits = keys.select(F.explode(F.array(*cells(F.col(key), bits))).alias("cell"))
    return _pack(hits.groupBy("cell").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1"))


def members(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Filter of the keys that occur."""
    return _pack(keys.select(F.explode(F.array(*cells(F.col(key), bits))).alias("cell")))


def _pack(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.expr("bitmap_bucket_number(cell)").alias("piece")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")
    )


def flagged(rows: DataFrame, key: str, pieces: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with a boolean column that is false only if the filter cannot hold ``key``."""
    out, tests = rows, []
    for i, cell in enumerate(cells(F.col(key), bits)):
        piece = F.broadcast(pieces.select(F.col("piece").alias(f"_piece{i}"), F.col("bits").alias(f"_bits{i}")))
        out = out.withColumn(f"_cell{i}", cell)
        out = out.join(piece, F.expr(f"bitmap_bucket_number(_cell{i})") == F.col(f"_piece{i}"), "left")
        at = F.expr(f"bitmap_bit_position(_cell{i})")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        tests.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    spare = [f"{name}{i}" for i in range(PROBES) for name in ("_cell", "_piece", "_bits")]
    hit = tests[0]
    for test in tests[1:]:
        hit = hit & test
    return out.withColumn(flag, hit).drop(*spare)
