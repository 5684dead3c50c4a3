"""What several operators share: tables between steps, balanced joins, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import shared_folder

# A key is heavy from 1/200 of the rows on, so at most 200 keys are broadcast.
HEAVY_SHARE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_AT_ONCE = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that what a task makes of their texts stays small."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)
    # The worker lives on for other tasks: it need not keep what this one's batches took.
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand at most 4 MB of rows at once to Python, or one row if that is larger.

    By default a batch may have 64 MB; with long texts its copies in the JVM, in
    flight and in Python add up to more than the task's own data.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy.

    Cuts lineage: a lost executor costs the tasks it was running, never the
    steps before. The folder is scratch space and belongs to the application.
    """
    path = f"{shared_folder(df.sparkSession)}/parchmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_totals(rows: DataFrame, totals: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` with what ``totals`` (one row per key) knows of their key.

    ``size`` is the number of ``rows`` a key has. Keys with 1/200 of ``n_rows``
    or more are at most 200 and are broadcast; no key of the shuffled rest
    holds more than that share. ``key`` is not null; rows without totals go.
    """
    is_heavy = F.col(size) * HEAVY_SHARE >= F.lit(max(n_rows, 1))
    heavy, light = totals.filter(is_heavy), totals.filter(~is_heavy)
    near = rows.join(F.broadcast(heavy), key)
    far = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return near.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs): node, component (smallest node).

    Alternates large-star and small-star steps until no edge changes; every
    step is joins and aggregates on the edge list, which only shrinks.
    """
    now = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Forest:
    """Union-find over small integers, for the links within one bounded group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
