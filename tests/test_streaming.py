import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parchmill.plans.pipeline import process_batch
from parchmill.sources.store import read_store
from parchmill.streaming import streams as Y

AS_OF = "2026-01-03 16:47:00"
PAGES = "/root/testdata/sf0.001/pages.parquet"


def landing(spark, path):
    pages = spark.read.parquet(PAGES).withColumnRenamed("page_id", "pos").filter("pos < 12")
    pages.filter("pos < 6").repartition(1).write.parquet(path)
    return pages


def test_stream_equals_batch(spark, tmp_path):
    pages = landing(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))

    def sink(results, batch_id):
        results.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch_id}"))

    def run():
        Y.stream_documents(stream, AS_OF, sink, str(tmp_path / "cp"), max_len=500).awaitTermination()

    run()
    pages.filter("pos >= 6").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    columns = ["pos", "markdown", "length", "truncated"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*columns).orderBy("pos").collect()
    assert streamed == process_batch(pages, AS_OF, max_len=500).results.select(*columns).orderBy("pos").collect()


def test_upsert_replay_changes_nothing(spark, tmp_path):
    pages = landing(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    for checkpoint in ("cp1", "cp2"):  # a lost checkpoint replays batch 0
        Y.stream_upsert(spark, stream, store, AS_OF, str(tmp_path / checkpoint)).awaitTermination()
    rows = read_store(spark, store).collect()
    assert len(rows) == 6 and len({r.url_key for r in rows}) == 6


def test_two_streams_keep_each_others_entries(spark, tmp_path):
    pages = spark.read.parquet(PAGES).withColumnRenamed("page_id", "pos").filter("pos < 10")
    store = str(tmp_path / "store")
    for name, part in (("one", "pos < 4"), ("two", "pos >= 4")):
        pages.filter(part).repartition(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / name))
        Y.stream_upsert(spark, stream, store, AS_OF, str(tmp_path / f"cp-{name}")).awaitTermination()
    assert len({r.url_key for r in read_store(spark, store).collect()}) == 10


def test_first_seen(spark, tmp_path):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2026-01-01 00:00:00', 'http://A.com/x'), (2, TIMESTAMP_NTZ'2026-01-01 01:00:00', 'http://a.com/x#f'),"
        " (3, TIMESTAMP_NTZ'2026-01-01 02:00:00', 'http://a.com/y') AS t(id, ts, url)"
    )
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    first = Y.stream_first_urls(stream).select(F.regexp_replace(F.lower("url"), "#.*", "").alias("u"))
    query = first.writeStream.format("memory").queryName("first_urls").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(r.u for r in spark.table("first_urls").collect()) == ["http://a.com/x", "http://a.com/y"]


def first_within(rows, limit):
    """Plain version: times of each key that no earlier result covers."""
    found, last = [], {}
    for key, at, name in sorted(rows):
        if key not in last or at > last[key] + limit:
            last[key] = at
            found.append((key, at, name))
    return found


@pytest.mark.parametrize("files", [1, 5])
def test_first_within_does_not_depend_on_micro_batches(spark, tmp_path, files):
    start = dt.datetime(2026, 1, 1)
    rng = random.Random(4)
    rows = [(k, start + dt.timedelta(hours=rng.randint(0, 24 * 30)), f"n{i}") for i, k in enumerate([1, 1, 1, 2, 3] * 60)]
    rows += [(7, start + dt.timedelta(days=d), "x") for d in (0, 10, 20)] + [(7, start, "a"), (8, start, "s"), (8, start, "s")]
    rows.sort(key=lambda r: (r[1] + dt.timedelta(hours=rng.randint(0, 20)), r[2]))  # late by less than a day
    closing = (None, start + dt.timedelta(days=90), "end")
    size = -(-len(rows) // files)
    for n in range(files + 1):
        part = rows[n * size : (n + 1) * size] if n < files else [closing]
        spark.createDataFrame(part, "k long, ts timestamp, name string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("k long, ts timestamp, name string").option("maxFilesPerTrigger", 1 if files > 1 else 1000)
    landing = source.parquet(str(tmp_path / "in/*"))
    query = (
        Y.stream_first_within(landing, "k", "ts", "1 day", "1 day")
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted((r.k, r.ts, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == first_within(rows, dt.timedelta(days=1))
    assert [r for r in got if r[0] == 7] == [(7, start, "a"), (7, start + dt.timedelta(days=10), "x"), (7, start + dt.timedelta(days=20), "x")]
