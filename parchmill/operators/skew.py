"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy from 1/n of the rows on, so there are at most n of them, and n
# rows are the most that is broadcast below. n follows the shuffle partitions:
# a key that stays whole is no larger than a partition. The sketch keeps at most
# half a million counters; beyond 65,536 partitions n stays there.
LEAST_SHARE, MOST_SHARE = 256, 1 << 16
COUNTERS_PER_KEY = 8


def heavy_share(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = LEAST_SHARE
    while share < min(partitions, MOST_SHARE):
        share *= 2
    return share


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with a partition's share of the rows or more, and the number of slots each gets.

    Found by a mergeable sketch in one map-side aggregate. The estimate only
    decides how rows are spread, never what a join returns.
    """
    share = heavy_share(df)
    most_slots = 4 * share
    sketch = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.expr(f"approx_top_k(`{key}`, {share}, {COUNTERS_PER_KEY * share})").alias("top"),
    )
    found = sketch.select("total", F.explode("top").alias("top"))
    slots = F.ceil(F.col("top.count") * most_slots / F.col("total"))
    return found.filter(
        F.col("top.item").isNotNull() & (F.col("top.count") > 1) & (F.col("top.count") * share >= F.col("total"))
    ).select(F.col("top.item").alias(key), F.least(slots, F.lit(most_slots)).cast("int").alias("_slots"))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", spread_by: str | Column = "pos") -> DataFrame:
    """Join on ``key`` where ``right`` has one row per key and ``left`` may be skewed.

    Rows of a heavy left key are spread over slots by ``spread_by``; the one
    right row of that key is repeated per slot, four times ``heavy_share`` plus
    one per heavy key in total at most.
    """
    heavy = F.broadcast(heavy_keys(left, key))
    spread = F.xxhash64(F.col(spread_by) if isinstance(spread_by, str) else spread_by)
    salted_left = left.join(heavy, key, "left").withColumn(
        "_slot", F.when(F.col("_slots").isNull(), 0).otherwise(F.pmod(spread, F.col("_slots"))).cast("int")
    )
    salted_right = right.join(heavy, key, "left").withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1))
    )
    return salted_left.drop("_slots").join(salted_right.drop("_slots"), [key, "_slot"], how).drop("_slot")
