"""Near duplicates of vectors by collision counting over sorted projections."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import Forest, components, join_totals, staged

# A block of one label's vectors; two blocks are compared in one task.
BLOCK = 1024
PROJECTIONS = 24
# A window reaches so many standard deviations of the projected difference of a pair at the threshold.
REACH = 1.5
RECALL = 0.995


def least_collisions(projections: int = PROJECTIONS, reach: float = REACH, recall: float = RECALL) -> int:
    """The largest count that a pair exactly at the threshold still reaches with probability ``recall``.

    Over random directions the projected difference of a pair is normal, with
    its distance as deviation, so collisions are binomial. Closer pairs collide more.
    """
    p = 2 * NormalDist().cdf(reach) - 1
    term = (1 - p) ** projections
    below, count = 0.0, 0
    while below + term <= 1 - recall:
        below += term
        term *= (projections - count) / (count + 1) * p / (1 - p)
        count += 1
    return count


def directions(dim: int, projections: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng((seed, dim)).normal(size=(dim, projections))


def collisions(queries: np.ndarray, data: np.ndarray, width: float) -> np.ndarray:
    """How many projections (columns) put each data row into the window centred on each query."""
    counts = np.zeros((len(queries), len(data)), dtype=np.int16)
    steps = np.zeros((len(queries), len(data) + 1), dtype=np.int16)
    at = np.arange(len(queries))
    for one in range(queries.shape[1]):
        order = np.argsort(data[:, one], kind="stable")
        line = data[order, one]
        low = np.searchsorted(line, queries[:, one] - width, "left")
        high = np.searchsorted(line, queries[:, one] + width, "right")
        steps[:] = 0
        np.add.at(steps, (at, low), 1)
        np.add.at(steps, (at, high), -1)
        inside = np.cumsum(steps[:, :-1], axis=1, dtype=np.int16)
        counts[:, order] += inside
    return counts


def near_pairs(queries: np.ndarray, data: np.ndarray, least_cosine: float, projections: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of unit vectors that collide often enough and whose cosine is large enough."""
    lines = directions(queries.shape[1], projections)
    width = REACH * (2 - 2 * least_cosine) ** 0.5
    rows, columns = np.nonzero(collisions(queries @ lines, data @ lines, width) >= least)
    ok = np.zeros(len(rows), dtype=bool)
    for i in range(0, len(rows), 1 << 16):
        part = slice(i, i + (1 << 16))
        ok[part] = np.einsum("ij,ij->i", queries[rows[part]], data[columns[part]]) >= least_cosine
    return rows[ok], columns[ok]


FOUND = "id long, other long, links long"


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.98, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are collapsed first and counted, so a group of
    copies costs one vector. What is left of a label is dealt into blocks by a
    hash; each pair of blocks is a task. There every vector's projections are
    sorted, the windows centred on the vectors of the other block are counted
    per pair, and pairs with at least the calibrated count are verified by
    cosine in double precision. A task returns for each vector its number of
    links and the links of a spanning forest: as many rows as it read.

    Vectors that are null, empty, zero, or hold a null, NaN or infinite
    component, those without label, and vectors of different lengths link with
    nothing. A null vec_id counts as the largest. Rows that repeat a vec_id are
    vectors of their own and links of each other; they share an id, and so a
    component. An empty table gives no rows.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    keyed = staged(
        rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn(
            "key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
        ),
        "vectors",
    )
    copies = keyed.filter("usable").groupBy("key", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim")).agg(
        F.min("row").alias("id"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding")
    )
    single = staged(copies, "distinct")
    sizes = single.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    spread = single.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, ["label", "dim"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    # A block goes to its pair with every block of the label, itself included.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        spread.withColumn("own", own)
        .withColumn("other", other)
        .select("label", "dim", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "id", "copies", "embedding")
    )
    least = least_collisions(projections)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, copies, own = (group.column(c).to_numpy() for c in ("id", "copies", "own"))
        flat = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        unit = flat.reshape(len(ids), -1)
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        left = np.flatnonzero(own == group.column("left")[0].as_py())
        right = np.flatnonzero(own == group.column("right")[0].as_py())
        a, b = near_pairs(unit[left], unit[right], least_cosine, projections, least)
        a, b = left[a], right[b]
        if own[left[:1]].tolist() == own[right[:1]].tolist():
            a, b = a[a < b], b[a < b]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        forest = Forest(len(ids))
        joined = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
        some = np.flatnonzero(links)
        one = np.concatenate([some, np.asarray([x for x, _ in joined], dtype=int)])
        return pa.table({
            "id": pa.array(ids[one], pa.int64()),
            "other": pa.array([None] * len(some) + [int(ids[y]) for _, y in joined], pa.int64()),
            "links": pa.array(links[some].astype(int).tolist() + [0] * len(joined), pa.int64()),
        })

    found = staged(dealt.groupBy("label", "dim", "left", "right").applyInArrow(compare, FOUND), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classed = (
        single.select("key", "id", "first", "copies")
        .join(links, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    classed = staged(classed, "classes")
    firsts = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    known = classed.join(firsts, "component").select(
        "key", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    used = keyed.filter("usable").select("vec_id", "key")
    linked = join_totals(used, known, "key", "copies", used.count()).select("vec_id", "n_links", "component_id")
    alone = keyed.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
