"""Which rows may have a key of a given set: a Bloom filter made and read with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits in one bitmap of the built-in bitmap functions.
PIECE_BITS = 32768

# 32 bits a key let 3 of 100 other rows through. A filter has at most 2^28 bits
# (32 MB to broadcast); beyond eight million keys it lets more through, and the
# join behind it, which is exact, has more to do.
BITS_PER_KEY = 32
MOST_BITS = 1 << 28


def likely(rows: DataFrame, keys: DataFrame, key: str | list[str], n_keys: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``; none with such a key is lost.

    Nothing is shuffled but the bitmaps: a test is a look-up in a broadcast
    table of 4 KB pieces, so it can stand in front of costly expressions and
    exchanges. ``n_keys`` sizes the filter and need not be exact.
    """
    bits = PIECE_BITS
    while bits < min(n_keys * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    # Counted from 1, as the bitmap functions do.
    cell = F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(bits)) + 1
    pieces = (
        keys.select(cell.alias("_cell"))
        .groupBy(F.expr("bitmap_bucket_number(_cell)").alias("_piece"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_cell))").alias("_bits"))
    )
    at = F.expr("bitmap_bit_position(_cell)")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    is_set = F.getbit(byte, (at % 8).cast("int")) == 1
    tested = rows.withColumn("_cell", cell)
    same_piece = F.expr("bitmap_bucket_number(_cell)") == F.col("_piece")
    return tested.join(F.broadcast(pieces), same_piece & is_set, "left_semi").drop("_cell")
