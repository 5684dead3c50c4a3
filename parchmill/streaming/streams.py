"""Incremental versions of the batch job with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from parchmill.functions.urls import url_key
from parchmill.operators.store import AsOf
from parchmill.plans.pipeline import process_batch, process_into_store


def stream_documents(
    pages: DataFrame, as_of: AsOf, sink: Callable[[DataFrame, int], None], checkpoint: str, **options
) -> StreamingQuery:
    """Convert pages (``pos, url, html, ...``) as they land; ``sink`` gets each batch of results.

    Extraction orders the rows of a page, which a streaming plan rejects, so
    each micro-batch runs the batch job. A replayed batch calls ``sink`` with
    the same id and the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(process_batch(batch, as_of, **options).results, batch_id)

    return (
        pages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_first_seen(stream: DataFrame, key: str | Column, time: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """The first row of each key within ``ttl``; later copies inside it are dropped.

    State holds one entry per key and leaves with the watermark. ``time`` is
    made a zoned timestamp, which watermarks need.
    """
    named = stream.withColumn("_key", F.col(key) if isinstance(key, str) else key)
    return (
        named.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, ttl)
        .dropDuplicatesWithinWatermark(["_key"])
        .drop("_key")
    )


def _as_bytes(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def stream_first_within(
    stream: DataFrame, key: str, time: str = "ts", limit: str = "24 hours", lateness: str = "0 seconds"
) -> DataFrame:
    """Rows of each ``key`` that no earlier result of it covers for ``limit``, in event time.

    The first row of a key is a result, and after each result the first one
    later than it by more than ``limit``. Rows wait in the state of their key
    until the watermark (the latest time less ``lateness``) has passed them and
    are then taken in order of time, so the results do not depend on how rows
    were dealt into micro-batches. Rows later than ``lateness`` are dropped by
    the engine. A timer per key wakes it for its next waiting row, and when its
    last result covers nothing any more, the state goes.

    Of rows of one key and time the smallest by its other columns counts. Rows
    without a key are no results but move the watermark, so a source that has
    ended can be closed with one; rows without a time are dropped. State holds one row per time that waits and
    can still become a result.
    """
    schema = stream.withColumn(time, F.col(time).cast("timestamp")).schema
    names = [f.name for f in schema.fields]
    order = [time, *[n for n in names if n not in (time, key)]]
    covered = pd.Timedelta(limit)

    def settle(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, None)
        until = pd.Timestamp.min if last is None else pd.Timestamp(last, unit="us") + covered
        parts = [pa.ipc.open_stream(waiting).read_pandas()] if waiting else []
        for frame in frames:
            open_rows = frame[frame[time] > until]
            parts.append(open_rows.sort_values(order).drop_duplicates(time))
        parts = [p for p in parts if len(p)]
        if parts:
            rows = pd.concat(parts, ignore_index=True).sort_values(order).drop_duplicates(time)
            times = rows[time].to_numpy("datetime64[us]").astype("int64")
            passed = state.getCurrentWatermarkMs() * 1000
            step = covered.value // 1000
            at, found = 0, []
            while at < len(times) and times[at] < passed:
                found.append(at)
                last = int(times[at])
                at = int(times.searchsorted(last + step, side="right"))
            rest = rows.iloc[max(at, int(times.searchsorted(passed))) :]
            if found:
                yield rows.iloc[found][names].reset_index(drop=True)
        else:
            rest = None
        wake = None if last is None else (last + covered.value // 1000) // 1000 + 1
        if rest is not None and len(rest):
            wake = int(rest[time].iloc[0].value // 1_000_000) + 1
        if wake is None or (wake <= state.getCurrentWatermarkMs() and not (rest is not None and len(rest))):
            state.remove()
            return
        state.update((last, _as_bytes(rest) if rest is not None and len(rest) else None))
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))

    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return (
        # One test that names the time as well, or it would move below the watermark and hide rows from it.
        timed.filter(F.when(F.col(time).isNotNull(), F.col(key).isNotNull()))
        .groupBy(key)
        .applyInPandasWithState(settle, schema, "last long, waiting binary", "append", "EventTimeTimeout")
    )


def stream_first_urls(stream: DataFrame, time: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """``stream_first_seen`` on the store key of ``url``."""
    return stream_first_seen(stream, url_key(F.col("url")), time, ttl)


def stream_upsert(
    spark: SparkSession, pages: DataFrame, store_path: str, as_of: AsOf, checkpoint: str, **options
) -> StreamingQuery:
    """Convert landing pages and add them to the page store.

    Each micro-batch looks up the store, converts what is missing and writes
    its entries under the stream's id and its own number: a replay replaces
    itself, and no other stream, batch job or new checkpoint does.
    """
    checkpoint = checkpoint.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        # The id is made with the checkpoint and kept in it.
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        process_into_store(batch, store_path, f"{stream}-{batch_id}", as_of, **options)

    return (
        pages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
