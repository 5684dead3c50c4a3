import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from parchmill.functions import errors as E
from parchmill.operators import results as RS
from parchmill.operators import render as R
from parchmill.operators import store as S
from parchmill.operators.skew import heavy_keys, skew_join
from parchmill.plans.pipeline import process_batch, process_into_store
from parchmill.schemas import RESULT, STORE
from parchmill.sources import pages as P
from parchmill.sources import sinks as K
from parchmill.sources import store as SS

AS_OF = "2026-01-03 16:47:00"
META = ("Title", "", "", "")


def entries(spark, rows):
    now = dt.datetime(2026, 1, 3, 16, 47)
    data = [("k" + u, u, now, md, META, now - dt.timedelta(hours=h)) for u, md, h in rows]
    from parchmill.functions.urls import url_key

    return spark.createDataFrame(data, STORE).withColumn("url_key", url_key(F.col("url"))).select(*STORE.names)


def results(spark, rows):
    """rows: (pos, markdown, failed, cached, truncated, full_length)"""
    error = (E.FETCH, "HTTP request failed: HTTP 404: 404 Not Found", "u", "")
    data = [
        (p, f"https://h{p % 2}.com/{p}", md, META, error if failed else None, cached, cut, full, len(md.encode()))
        for p, md, failed, cached, cut, full in rows
    ]
    return spark.createDataFrame(data, RESULT)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(0, "x" * 70, False, False, False, 70), (1, "x" * 91, False, True, True, 91)], (2, 2, 0, 1, 161, 80, 1)),
        ([(0, "a", False, False, False, 1), (1, "", True, True, True, 0), (2, "b", False, True, False, 0)], (3, 2, 1, 1, 2, 1, 0)),
        ([(i, "", True, False, False, 0) for i in range(4)], (4, 0, 4, 0, 0, 0, 0)),
        ([], (0, 0, 0, 0, 0, 0, 0)),
        ([(i, "", False, False, False, 700 + i) for i in range(3)], (3, 3, 0, 0, 2103, 701, 0)),
    ],
)
def test_stats(spark, rows, expected):
    assert tuple(RS.batch_stats(results(spark, rows)).first()) == expected


def test_errors(spark):
    df = spark.range(1).select(
        E.error_struct(E.GENERIC, F.lit("u"), F.lit("boom")).alias("a"),
        E.error_struct(E.FETCH, F.lit("u"), F.lit("boom")).alias("b"),
        E.cache_error(F.lit("get"), F.lit("boom")).alias("c"),
    )
    row = df.select("*", *[E.error_text(F.col(c)).alias(c + "t") for c in "abc"], *[E.error_class(F.col(c)["code"]).alias(c + "n") for c in "abc"]).first()
    assert (row.at, row.bt, row.ct) == (
        "generic_error: boom", "fetch_failed: HTTP request failed: boom (u)", "cache_error: Cache get failed: boom"
    )
    assert (row.an, row.bn, row.cn) == (1, 2, 4)
    assert row.c.context == "get"


def test_lookup_age_and_spelling(spark):
    store = entries(spark, [("https://example.com/page?a=2&z=1", "new", 24), ("https://example.com/old", "old", 25)])
    urls = spark.createDataFrame([(0, "HTTPS://EXAMPLE.COM/page?z=1&a=2#frag"), (1, "https://example.com/old"), (2, "https://example.com/none")], "pos long, url string")
    found = {r.pos: r for r in S.store_lookup(urls, store, AS_OF).collect()}
    assert found[0].cached and found[0].markdown == "new" and found[0].full_length == 0
    assert not found[1].cached and not found[2].cached
    assert [r.pos for r in S.store_hits(urls, store, AS_OF).collect()] == [0]
    assert sorted(r.pos for r in S.store_misses(urls, store, AS_OF).collect()) == [1, 2]
    assert S.store_hits(urls, store, AS_OF, dt.timedelta(0)).count() == 1
    assert [r.markdown for r in S.expired_entries(store, AS_OF).collect()] == ["old"]


def test_upsert_last_write_wins(spark):
    merged = S.store_upsert(entries(spark, [("https://a/1", "one", 3), ("https://a/2", "two", 3)]), entries(spark, [("https://a/1", "uno", 1)]))
    assert {(r.url, r.markdown) for r in merged.collect()} == {("https://a/1", "uno"), ("https://a/2", "two")}


def test_store_round_trip_clear_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    assert SS.read_store(spark, path).count() == 0
    missing = SS.store_clear(spark, path).first()
    assert (missing.status, missing.reason) == ("already_empty", "directory_does_not_exist")
    SS.write_store(entries(spark, [("https://a/1", "one", 3)]), path, batch_id=1)
    SS.write_store(entries(spark, [("https://a/1", "uno", 1), ("https://a/2", "two", 1)]), path, batch_id=2)
    SS.write_store(entries(spark, [("https://a/1", "uno", 1), ("https://a/2", "two", 1)]), path, batch_id=2)
    assert SS.read_store(spark, path).count() == 3
    assert SS.read_store(spark, path, without_batch=2).count() == 1
    compacted = str(tmp_path / "compacted")
    SS.compact_store(SS.read_store(spark, path), compacted)
    assert SS.read_store(spark, compacted).count() == 2
    SS.write_store(entries(spark, [("https://a/3", "three", 1)]), compacted)
    assert {r.markdown for r in SS.read_store(spark, compacted).collect()} == {"uno", "two", "three"}
    stats = S.store_stats(SS.read_store(spark, path), path).first()
    assert (stats.entries, stats.total_size, stats.average_entry_size) == (3, "9 B", "3 B")
    report = SS.store_clear(spark, path).first()
    assert (report.status, report.entries_removed) == ("cleared", 3)
    assert SS.read_store(spark, path).count() == 0
    empty = S.store_stats(SS.read_store(spark, path), path).first()
    assert (empty.entries, empty.total_size, empty.average_entry_size) == (0, "0 B", None)


def test_json_layout_survives_corrupt_files(spark, tmp_path):
    entry = {
        "url": "https://a/1", "fetchedAt": "2026-01-03T16:46:53.123456789Z", "markdown": "# T",
        "metadata": {"Title": "T", "Author": "", "PublishDate": "", "Description": "d"},
    }
    (tmp_path / ("a" * 64 + ".json")).write_text(json.dumps(entry, indent=2))
    (tmp_path / ("b" * 64 + ".json")).write_text('{"url": "https://a/2", "mark')
    (tmp_path / ("c" * 64 + ".json")).write_text("")
    rows = SS.read_store(spark, str(tmp_path), layout="json").collect()
    assert [(r.url_key, r.url, r.markdown, r.meta.title) for r in rows] == [("a" * 64, "https://a/1", "# T", "T")]
    assert SS.store_file_stats(spark, str(tmp_path)).first().entries == 3
    cleared = SS.store_clear(spark, str(tmp_path), layout="json").first()
    assert (cleared.status, cleared.entries_removed) == ("cleared", 3) and not list(tmp_path.glob("*.json"))


def test_files_of_entries(spark, tmp_path):
    path = str(tmp_path / "store")
    assert SS.store_file_stats(spark, path).first().entries == 0
    old = entries(spark, [("https://a/1", "one", 2), ("https://a/1", "newer", 1), ("https://a/2", "zwölf \"\n", 1)])
    SS.write_store_files(old, path)
    found = {r.url: r for r in SS.read_store(spark, path, layout="json").collect()}
    assert {u: r.markdown for u, r in found.items()} == {"https://a/1": "newer", "https://a/2": "zwölf \"\n"}
    assert {r.url_key for r in found.values()} == {r.url_key for r in old.collect()}
    SS.write_store_files(entries(spark, [("https://a/2", "again", 3)]), path)
    again = {r.url: r.markdown for r in SS.read_store(spark, path, layout="json").collect()}
    assert again == {"https://a/1": "newer", "https://a/2": "again"}
    (tmp_path / "store" / "prefix=00" / "url_key=0").mkdir(parents=True, exist_ok=True)
    (tmp_path / "store" / "prefix=00" / "url_key=0" / "empty.json").write_text("")
    (tmp_path / "store" / ("d" * 64 + ".json")).write_text('{"url": "https://a/3", "markdown": "flat"}')
    assert SS.store_file_stats(spark, path).first().entries == 4
    flat = SS.read_store(spark, path, layout="json").filter("url = 'https://a/3'").first()
    assert (flat.url_key, flat.markdown) == ("d" * 64, "flat")
    assert SS.store_clear(spark, path, layout="json").first().entries_removed == 4
    assert SS.store_file_stats(spark, path).first().entries == 0 and SS.read_store(spark, path, layout="json").count() == 0


def test_files_of_entries_are_read_as_spark_reads_them(spark, tmp_path, monkeypatch):
    path = tmp_path / "store"
    keys = ["0a", "0b c", "é%/=:", "", None, "_d", "x" * 64]
    rows = entries(spark, [(f"https://a/{i}", f"text \u20ac {i}\n", i) for i in range(len(keys))]).drop("url_key")
    number = F.regexp_extract("url", r"(\d+)$", 1).cast("int")
    rows = rows.withColumn("url_key", F.element_at(F.array(*map(F.lit, keys)), number + 1))
    here, spark_own = path / "here", path / "spark"
    SS.write_store_files(rows, str(here))
    with monkeypatch.context() as patch:
        patch.setattr(SS.entry_files, "local_folder", lambda *_: None)
        SS.write_store_files(rows, str(spark_own))
    folders = lambda root: {str(f.relative_to(root)): f.read_bytes() for d in root.glob("*/*") for f in [next(d.glob("[!.]*"))]}
    bare = lambda found: {k.rpartition("/")[0]: v for k, v in found.items()}
    assert bare(folders(here)) == bare(folders(spark_own)) and len(folders(here)) == 6
    good = '{"url": "https://b/1", "fetchedAt": "2026-01-03T16:46:53.5Z", "markdown": "b"}'
    odd = {
        "array.json": f"[{good}, {good}]".encode(), "bom.json": b"\xef\xbb\xbf" + good.encode(), "wide.json": good.encode("utf-16"),
        "bytes.json": good.encode().replace(b'"b"', b'"\xff"'), "two.json": f"{good}\n{good}".encode(), "type.json": good.replace('"b"', "[1]").encode(),
        "time.json": good.replace("2026", "when").encode(), "none.json": b"", "torn.json": good.encode()[:-9], "null.json": b"null", "_hid.json": good.encode(),
        ".hid.json": good.encode(), "sp ace%20é\u2003#.json": good.encode(), "noend": good.encode(), "prefix=0a/url_key=0a/beside.txt": good.encode(), "deep/er/in.json": good.encode(),
        "deep/_x/in.json": good.encode(), "deep/_x=1/in.json": good.encode(), "number.json": b"7", "spaced.json": f" \n[{good}]".encode(),
    }
    for name, data in odd.items():
        (here / name).parent.mkdir(parents=True, exist_ok=True)
        (here / name).write_bytes(data)
    mine = sorted(map(str, SS.read_store(spark, str(here), layout="json").collect()))
    monkeypatch.setattr(SS.entry_files, "local_folder", lambda *_: None)
    theirs = sorted(map(str, SS.read_store(spark, str(here), layout="json").collect()))
    assert (set(mine) - set(theirs), set(theirs) - set(mine)) == (set(), set())
    assert mine == theirs and len(mine) > 12


def test_the_driver_holds_no_list_of_entry_files(spark, tmp_path):
    rows = entries(spark, [(f"https://a/{i}", "text", 1) for i in range(40)])
    SS.write_store_files(rows, str(tmp_path / "store"))
    read = SS.read_store(spark, str(tmp_path / "store"), layout="json")
    assert read.inputFiles() == [] and read.count() == 40


def test_entry_files_are_put_and_counted_by_tasks(spark, tmp_path, monkeypatch):
    path = tmp_path / "store"
    monkeypatch.setattr(SS, "_listing", None)  # what the driver would list with
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.json", None)
    for text in ("one", "other"):
        SS.write_store_files(entries(spark, [(f"https://a/{i}", text, 1) for i in range(30)]), str(path))
    files = list(path.glob("prefix=*/url_key=*/*"))
    assert len(files) == len({f.parent for f in files}) == 30
    (files[0].parent / ".draft-0").write_bytes(b"{")
    stats = SS.store_file_stats(spark, str(path)).first()
    assert stats.entries == 30 and stats.average_entry_size == f"{sum(f.stat().st_size for f in files) // 30} B"


def test_entry_files_are_cleared_by_tasks(spark, tmp_path, monkeypatch):
    path = tmp_path / "store"
    monkeypatch.setattr(SS, "_listing", None)  # what the driver would list and delete with
    SS.write_store_files(entries(spark, [(f"https://a/{i}", "text", 1) for i in range(30)]), str(path))
    (path / ("e" * 64 + ".json")).write_text("")
    (path / ("." + "e" * 64 + ".json.crc")).write_text("")
    (path / "letters.txt").write_text("dear store")
    with pytest.raises(ValueError, match="no json store: it holds letters.txt"):
        SS.store_clear(spark, str(path), layout="json")
    (path / "letters.txt").unlink()
    report = SS.store_clear(spark, str(path), layout="json").first()
    assert (report.status, report.entries_removed, report.reason) == ("cleared", 31, None)
    assert [f.name for f in path.iterdir()] == ["_SUCCESS"]
    again = SS.store_clear(spark, str(path), layout="json").first()
    assert (again.status, again.entries_removed) == ("already_empty", 0)


def test_clearing_leaves_other_folders_alone(spark, tmp_path):
    (tmp_path / "letters.txt").write_text("dear store")
    for layout in ("parquet", "json"):
        with pytest.raises(ValueError, match="no .* store"):
            SS.store_clear(spark, str(tmp_path), layout)
    assert (tmp_path / "letters.txt").exists()


def test_an_unreadable_file_fails_unless_told_otherwise(spark, tmp_path):
    path = tmp_path / "store"
    SS.write_store(entries(spark, [("https://a/1", "one", 1)]), str(path), batch_id=1)
    (path / "batch=2").mkdir()
    (path / "batch=2" / "part-0.parquet").write_bytes(b"PAR1 not a file PAR1")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        SS.read_store(spark, str(path)).collect()
    assert [r.markdown for r in SS.read_store(spark, str(path), skip_corrupt=True).collect()] == ["one"]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    SS.write_store(entries(spark, [("https://a.com/stored", "from the store", 1)]), path, batch_id=0)
    seen = []
    for _ in range(2):
        batch = process_into_store(landed(spark), path, "day", AS_OF)
        seen.append((sorted(map(tuple, SS.read_store(spark, path).collect())), sorted(map(tuple, batch.results.collect()))))
    assert seen[0] == seen[1] and len(seen[0][0]) == 3


def test_heavy_key_is_spread_and_join_is_exact(spark):
    left = spark.range(3000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    right = left.select("key").distinct().withColumn("value", F.length("key"))
    slots = {r.key: r._slots for r in heavy_keys(left, "key").collect()}
    assert set(slots) == {"hot"} and slots["hot"] > 100
    joined = skew_join(left, right, "key")
    assert joined.count() == 3000 and joined.filter("value is null or value <> length(key)").count() == 0
    assert skew_join(left, right.filter("key = 'hot'"), "key", "left_anti").count() == 2000
    assert skew_join(left, right.filter("key = 'hot'"), "key", "left_semi").count() == 1000


PAGE = "<title>T{0}</title><article><p>Article number {0}, with enough text to be scored.</p></article>"


def landed(spark):
    rows = [
        (0, "https://a.com/x", PAGE.format(0), 404, "404 Not Found"),
        (1, "https://A.com/x#again", PAGE.format(1), 200, "200 OK"),
        (2, "https://a.com/x", PAGE.format(2), 500, "500 Internal Server Error"),
        (3, "ftp://a.com/y", PAGE.format(3), 200, "200 OK"),
        (4, "https://a.com/stored", PAGE.format(4), 500, "500 Internal Server Error"),
        (5, "https://b.com/%zz", PAGE.format(5), 200, "200 OK"),
        (6, "https://b.com/z", PAGE.format(6), 200, "200 OK"),
    ]
    return spark.createDataFrame(rows, "pos long, url string, html string, status int, status_line string")


def test_batch(spark):
    store = entries(spark, [("https://a.com/stored", "from the store", 1)])
    batch = process_batch(landed(spark), AS_OF, store, max_len=60, ordered=True)
    rows = batch.results.collect()
    assert [r.pos for r in rows] == list(range(7))
    codes = [r.error.code if r.error else None for r in rows]
    assert codes == ["fetch_failed", None, None, "invalid_url", None, "extraction_failed", None]
    assert rows[0].error.message == "HTTP request failed: HTTP 404: 404 Not Found"
    assert [r.cached for r in rows] == [False, False, True, False, True, False, False]
    # A repeated URL gets the first success whole, under its own spelling.
    assert rows[1].truncated and not rows[2].truncated
    assert "Article number 1" in rows[2].markdown and "**URL:** https://A.com/x#again" in rows[2].markdown
    assert rows[4].markdown == "from the store" and rows[4].full_length == 0
    kept = {r.url: r.markdown for r in batch.entries.collect()}
    assert set(kept) == {"https://a.com/x", "https://b.com/z"}
    assert kept["https://a.com/x"] == rows[2].markdown
    stats = RS.batch_stats(batch.results).first()
    assert stats.success + stats.failed == stats.total == 7


def test_batch_without_cache(spark):
    rows = process_batch(landed(spark), AS_OF, entries(spark, [("https://a.com/stored", "s", 1)]), no_cache=True, ordered=True).results.collect()
    assert [r.error.code if r.error else None for r in rows] == ["fetch_failed", None, "fetch_failed", "invalid_url", "fetch_failed", "extraction_failed", None]
    assert not any(r.cached for r in rows)


def test_strict_batch_stops_at_the_first_invalid_url(spark):
    with pytest.raises(ValueError, match="ftp://a.com/y"):
        process_batch(landed(spark), AS_OF, strict=True)


def test_fields(spark):
    assert RS.parse_fields(None) == ["url", "title", "length", "cached"]
    assert RS.parse_fields(" url, nope,date ,url") == ["url", "date"]
    shown = R.toon_records(results(spark, [(0, "a-b", False, True, False, 0)]), "date,cached,length,content").first()
    assert shown.toon == 'date: ""\ncached: true\nlength: 3\ncontent: "a-b"'


def read_dataset(spark, path):
    return "".join(r.value + "\n" for r in spark.read.text(path).collect())


def test_save(spark, tmp_path):
    rows = results(spark, [(i, f"doc {i}\n", i % 3 == 1, False, False, 6) for i in range(7)])
    K.save(rows, str(tmp_path / "md"))
    text = "\n---\n## Next Article\n---\n\n".join(f"doc {i}\n" for i in range(7) if i % 3 != 1)
    files = sorted((tmp_path / "md").glob("part-*"))
    assert "".join(f.read_text() for f in files) == text + "\n"
    parts = R.markdown_document(rows, rows_per_part=2).orderBy("part").collect()
    assert "".join(p.document for p in parts) == text

    K.save(rows, str(tmp_path / "toon"), "toon", "url,length", aggregates=True)
    saved = "".join(f.read_text() for f in sorted((tmp_path / "toon").glob("part-*")))
    parts = R.toon_document(rows, "url,length", RS.batch_stats(rows), rows_per_part=2).orderBy("part").collect()
    assert saved == "".join(p.toon for p in parts)
    assert saved.startswith("total: 7\nsuccess: 5\nfailed: 2\n")
    assert 'url: "https://h0.com/0"\nlength: 6\nurl: "https://h1.com/1"\nerror: "HTTP request failed: HTTP 404: 404 Not Found"\ncode: fetch_failed\n' in saved

    K.save(rows, str(tmp_path / "json"), "json", "url,author")
    lines = [json.loads(line) for f in sorted((tmp_path / "json").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == {"url": "https://h0.com/0", "author": ""} and lines[1]["code"] == "fetch_failed"

    with pytest.raises(ValueError, match="unsupported format"):
        K.save(rows, str(tmp_path / "no"), "xml")

    K.write_page_files(rows, str(tmp_path / "files"))
    names = {p.name.removeprefix("filename=") for p in (tmp_path / "files").glob("filename=*")}
    assert len(names) == 5 and {"h0-com-title.md", "h1-com-title.md"} <= names


def test_pieces_of_a_document_are_bounded_in_bytes(spark):
    sizes = [10, 3000, 400, 400, 400, 400, 999, 5, 5, 5, 2001, 0, 600, 600, 600]
    rows = results(spark, [(i, chr(97 + i) * n, False, False, False, n) for i, n in enumerate(sizes)])
    whole = R.markdown_document(rows, rows_per_part=7).orderBy("part", "piece").collect()
    small = R.markdown_document(rows, rows_per_part=7, max_bytes=1000).orderBy("part", "piece").collect()
    assert "".join(p.document for p in small) == "".join(p.document for p in whole) and {p.piece for p in whole} == {0}
    separator = len(R.ARTICLE_SEPARATOR)
    over = [p.document for p in small if len(p.document) > 1000]
    # Only a text above the limit by itself makes a larger piece, and stands there alone.
    assert sorted(len(d) - separator for d in over) == [999, 2001, 3000] and len(small) > len(whole) + 5
    table = R.toon_table(rows.select("pos", "markdown", F.lit(None).cast("string").alias("g")), ["markdown"], ["g"], 4, max_bytes=700)
    parts = table.orderBy("part", "piece").collect()
    lines = "".join(p.toon for p in parts).split("\n")
    assert lines[0] == "results[15]{markdown}:" and [len(x.strip().strip('"')) for x in lines[1:]] == sizes
    assert max(len(p.toon) for p in parts) <= 3000 + 3


def test_fetch_outcome_and_batches(spark, tmp_path):
    log = spark.createDataFrame([("u", 200, "200 OK"), ("u", 302, "302 Found"), ("u", 403, "403 Forbidden")], "url string, status int, status_line string")
    assert [r.ok for r in P.fetch_outcome(log).collect()] == [True, False, False]
    (tmp_path / "urls.txt").write_text("https://b\n\nhttps://a\nhttps://b\n")
    assert [r.url for r in P.url_batch(spark, str(tmp_path / "urls.txt")).orderBy("pos").collect()] == ["https://b", "https://a", "https://b"]
    assert P.url_batch(spark, ["https://b", "https://b"]).count() == 2
    (tmp_path / "many").mkdir()
    for name, n in (("a", 3), ("b", 900), ("c", 40)):
        (tmp_path / "many" / name).write_text("".join(f"https://{name}/{i}\n" for i in range(n)))
    found = P.url_batch(spark, str(tmp_path / "many")).orderBy("pos").collect()
    assert [r.url for r in found] == [f"https://{name}/{i}" for name, n in (("a", 3), ("b", 900), ("c", 40)) for i in range(n)]
    assert [r.pos for r in found] == list(range(943))
