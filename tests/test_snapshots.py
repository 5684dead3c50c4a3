"""Bucketed snapshots of the store, look-ups that read little, and one conversion per page."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from parchmill.functions.urls import url_key
from parchmill.operators import store as S
from parchmill.operators.membership import likely
from parchmill.operators.results import batch_stats
from parchmill.plans.pipeline import process_batch, process_into_store
from parchmill.schemas import STORE
from parchmill.sources import snapshots as SN
from parchmill.sources.sinks import save

AS_OF = "2026-01-03 16:47:00"
PAGES = "/root/testdata/sf0.001/pages.parquet"


def entries(spark, rows):
    """rows: (url, markdown, age in hours)"""
    now = dt.datetime(2026, 1, 3, 16, 47)
    meta = ("Title", "", "", "")
    data = [("", u, now, md, meta, now - dt.timedelta(hours=h)) for u, md, h in rows]
    return spark.createDataFrame(data, STORE).withColumn("url_key", url_key(F.col("url"))).select(*STORE.names)


def held(df):
    return sorted((r.url, r.markdown) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filter_loses_no_key(spark):
    rows = spark.range(200_000).withColumn("id", F.when(F.col("id") % 1000 != 7, F.col("id")))
    keys = spark.range(0, 200_000, 100)
    passed = likely(rows, keys, "id", 2000)
    assert passed.join(keys, "id", "left_semi").count() == 2000
    assert passed.count() < 2000 + 0.06 * 200_000
    assert likely(rows, keys.limit(0), "id", 0).count() == 0
    full = likely(rows, spark.range(200_000), "id", 1)  # a filter far too small lets all through
    assert full.filter("id is not null").count() == 200_000 - 200


def test_writes_replays_and_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert SN.read_snapshot(spark, path).count() == 0 and SN.versions(spark, path) == []
    assert SN.write_entries(entries(spark, [("https://a/1", "one", 3)]), path, "x") == 1
    assert SN.write_entries(entries(spark, [("https://a/1", "uno", 1), ("https://a/2", "two", 1)]), path, "y") == 2
    assert SN.write_entries(entries(spark, [("https://a/1", "uno", 1), ("https://a/2", "zwei", 1)]), path, "y") == 3
    assert held(SN.read_snapshot(spark, path)) == [("https://a/1", "one"), ("https://a/1", "uno"), ("https://a/2", "zwei")]
    assert held(SN.read_snapshot(spark, path, without_label="y")) == [("https://a/1", "one")]
    assert held(SN.read_snapshot(spark, path, 2)) == [("https://a/1", "one"), ("https://a/1", "uno"), ("https://a/2", "two")]
    SN.write_entries(entries(spark, []), path, "none")
    assert SN.read_snapshot(spark, path).count() == 3


def test_readers_keep_their_snapshot_over_a_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    SN.write_entries(entries(spark, [("https://a/1", "one", 30), ("https://a/2", "two", 2)]), path, "x")
    SN.write_entries(entries(spark, [("https://a/1", "uno", 26)]), path, "y")
    reader = SN.read_snapshot(spark, path)
    SN.compact_snapshot(spark, path)
    assert held(SN.read_snapshot(spark, path)) == [("https://a/1", "uno"), ("https://a/2", "two")]
    SN.compact_snapshot(spark, path, AS_OF)
    assert held(SN.read_snapshot(spark, path)) == [("https://a/2", "two")]
    assert held(reader) == [("https://a/1", "one"), ("https://a/1", "uno"), ("https://a/2", "two")]
    gone = SN.drop_old_snapshots(spark, path, keep=1)
    assert len(gone) == 3 and len(SN.versions(spark, path)) == 1
    assert held(SN.read_snapshot(spark, path)) == [("https://a/2", "two")]


def test_a_write_during_a_compaction_is_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    SN.write_entries(entries(spark, [("https://a/1", "one", 3)]), path, "x")
    write_folder = SN._write_folder

    def and_another(df, place, label):
        folder = write_folder(df, place, label)
        if label == "compacted":
            SN.write_entries(entries(spark, [("https://a/2", "two", 1)]), place, "y")
        return folder

    monkeypatch.setattr(SN, "_write_folder", and_another)
    SN.compact_snapshot(spark, path)
    assert held(SN.read_snapshot(spark, path)) == [("https://a/1", "one"), ("https://a/2", "two")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    create, calls = SN._Files.create, []

    def late(self, name, text):
        calls.append(name)
        if len(calls) == 1:  # someone else makes this version first
            monkeypatch.setattr(SN._Files, "create", create)
            SN.write_entries(entries(spark, [("https://a/2", "two", 1)]), path, "other")
        return create(self, name, text)

    monkeypatch.setattr(SN._Files, "create", late)
    assert SN.write_entries(entries(spark, [("https://a/1", "one", 1)]), path, "own") == 2
    assert held(SN.read_snapshot(spark, path)) == [("https://a/1", "one"), ("https://a/2", "two")]


def test_look_ups_read_the_buckets_of_their_keys(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "store")
    urls = [f"https://a.com/{i}" for i in range(400)]
    SN.write_entries(entries(spark, [(u, "text " + u, 1) for u in urls]), path, "x")
    asked = spark.createDataFrame([(0, urls[5]), (1, urls[9]), (2, "https://a.com/none")], "pos long, url string")
    found = S.store_lookup(asked, SN.read_snapshot(spark, path), AS_OF)
    assert sorted((r.pos, r.markdown) for r in found.collect()) == [(0, "text " + urls[5]), (1, "text " + urls[9]), (2, None)]
    buckets = {r[0] for r in S.with_key(asked).select(SN.bucket_of(F.col("url_key"))).collect()}
    with_text = [line for line in plan(found).splitlines() if "FileScan parquet" in line and "markdown" in line]
    assert with_text
    for line in with_text:
        filters = re.search(r"PartitionFilters: \[([^\]]*)", line).group(1)
        named = re.search(r"bucket#\d+ (?:IN \(([^)]*)\)|INSET ([^,]*(?:, \d+)*))", filters)
        assert {int(n) for n in (named.group(1) or named.group(2)).split(",")} <= buckets


def test_markdown_is_fetched_for_winners_only(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "store")
    urls = [f"https://a.com/{i}" for i in range(300)]
    SN.write_entries(entries(spark, [(u, "old", 5) for u in urls] + [(u, "new", 1) for u in urls]), path, "x")
    asked = S.with_key(spark.createDataFrame([(i, u) for i, u in enumerate(urls[:3])], "pos long, url string"))
    store = SN.read_snapshot(spark, path).drop("bucket")  # one bucket, as it were
    found = S.asked_entries(store, asked, AS_OF)
    assert {r.markdown for r in found.collect()} == {"new"}
    text = plan(found)
    # The broadcast filter stands between the scan of Markdown and its exchange.
    below = text[text.index("Exchange hashpartitioning(url_key") :] if "Exchange hashpartitioning(url_key" in text else text
    assert "BroadcastHashJoin [static_invoke(BitmapExpressionUtils.bitmapBucketNumber" in below


def test_a_page_is_converted_once(spark, tmp_path):
    landed = spark.read.parquet(PAGES).withColumnRenamed("page_id", "pos").filter("pos < 8")
    for layout in ("batches", "snapshots"):
        path = str(tmp_path / layout)
        batch = process_into_store(landed, path, 1, AS_OF, layout=layout, max_len=500)
        # Whatever is read afterwards takes the written copy: nothing reads HTML.
        for df in (batch.results, batch.entries, batch_stats(batch.results)):
            assert "html" not in plan(df)
        save(batch.results, str(tmp_path / f"out-{layout}"), "toon", "url,length,cached", aggregates=True)
        again = process_into_store(landed, path, 1, AS_OF, layout=layout, max_len=500)
        columns = ["pos", "url", "markdown", "cached", "length"]
        assert again.results.select(*columns).orderBy("pos").collect() == batch.results.select(*columns).orderBy("pos").collect()
        later = process_batch(landed, AS_OF, SN.read_snapshot(spark, path)) if layout == "snapshots" else None
        assert later is None or {r.cached for r in later.results.collect()} == {True}


def test_a_batch_of_hits_cleans_no_page(spark, tmp_path, monkeypatch):
    from parchmill.operators import extract as X

    landed = spark.read.parquet(PAGES).withColumnRenamed("page_id", "pos")
    path = str(tmp_path / "store")
    process_into_store(landed, path, 1, AS_OF, layout="snapshots")
    cleaned = spark.sparkContext.accumulator(0)
    clean_pages = X.clean_pages

    def counted(pages):
        rows = pages.count()
        cleaned.add(rows)
        return clean_pages(pages)

    monkeypatch.setattr(X, "clean_pages", counted)
    batch = process_into_store(landed, path, 2, AS_OF, layout="snapshots")
    assert {r.cached for r in batch.results.collect()} == {True}
    assert cleaned.value == 0
    fresh = landed.withColumn("url", F.when(F.col("pos") % 10 == 0, F.concat("url", F.lit("&new"))).otherwise(F.col("url")))
    some = process_into_store(fresh, path, 3, AS_OF, layout="snapshots")
    n_new = some.results.filter("not cached").count()
    assert 0 < n_new <= cleaned.value <= n_new + 0.1 * landed.count() + 3
