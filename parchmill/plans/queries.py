"""Registered queries: one per operator, each over whole tables.

Inputs that the tables lack are derived from them by expressions that
``oracle`` repeats in SQL: fetch status, store age, URL variants.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.functions import errors as E
from parchmill.functions import html as H
from parchmill.functions import text as TX
from parchmill.functions import toon as TN
from parchmill.functions import urls as U
from parchmill.operators import convert as C
from parchmill.operators import extract as X
from parchmill.operators import render as R
from parchmill.operators import results as RS
from parchmill.operators import store as S
from parchmill.plans.pipeline import process_batch, process_into_store, truncate_markdown
from parchmill.schemas import STORE
from parchmill.session import prepare, shared_folder
from parchmill.sources import pages as P
from parchmill.sources import sinks as K
from parchmill.sources import snapshots as SN
from parchmill.sources import store as SS
from parchmill.streaming import streams as Y

AS_OF = "2026-01-03 16:47:00"
ROWS_PER_PART = 500
PIECE_BYTES = 50_000
MAX_LEN = 1000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    _QUERIES[build.__name__.strip("_")] = run
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# --- inputs -------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan_pages(spark, f"{sf_dir}/pages.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def fetch_log(landed: DataFrame) -> DataFrame:
    """Landed pages as a fetch log with a status for each."""
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 17 == 1, 500).otherwise(200)
    line = F.when(status == 404, "404 Not Found").when(status == 500, "500 Internal Server Error").otherwise("200 OK")
    return landed.withColumns({"status": status, "status_line": line})


def variant_url(url: str | Column) -> Column:
    """Another spelling of the same page: host in capitals, with a fragment."""
    shouted = F.concat(
        F.regexp_extract(url, "^(https?://)", 1),
        F.upper(F.regexp_extract(url, "^https?://([^/?#]*)", 1)),
        F.regexp_extract(url, "^https?://[^/?#]*(.*)$", 1),
    )
    return F.when(F.contains(url, F.lit("#")), shouted).otherwise(F.concat(shouted, F.lit("#again")))


def batch_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page twice: as landed, and later under another spelling that always succeeds.

    A page whose own fetch failed has its first success in the second row.
    """
    log = fetch_log(pages(spark, sf_dir))
    total = F.lit(1_000_000_000)
    first = log.select(F.col("page_id").alias("pos"), "url", "html", "status", "status_line")
    again = log.select(
        (F.col("page_id") + total).alias("pos"),
        variant_url(F.col("url")).alias("url"),
        "html",
        F.lit(200).alias("status"),
        F.lit("200 OK").alias("status_line"),
    )
    return first.unionByName(again)


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with an entry per page, up to 47 hours old."""
    age = F.make_dt_interval(F.lit(0), (F.col("page_id") % 48).cast("int"))
    stamp = F.lit(AS_OF).cast("timestamp") - age
    none = F.lit("")
    meta = F.struct(
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        none.alias("author"),
        none.alias("publish_date"),
        none.alias("description"),
    )
    return pages(spark, sf_dir).select(
        U.url_key(F.col("url")).alias("url_key"),
        U.normalize_url(F.col("url")).alias("url"),
        stamp.alias("fetched_at"),
        F.concat(F.lit("stored "), "url").alias("markdown"),
        meta.alias("meta"),
        stamp.alias("stored_at"),
    )


def simple_results(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    """Result rows over ``documents``: the text as Markdown, every kind of outcome."""
    doc = texts(spark, sf_dir)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id"))
    kind = F.col("doc_id") % 19
    status = F.when(kind == 0, 404).when(kind == 1, 500).otherwise(200)
    line = F.when(kind == 0, "404 Not Found").when(kind == 1, "500 Internal Server Error").otherwise("200 OK")
    meta = F.struct(
        F.regexp_extract("text", "^([^\n]*)", 1).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit("")).alias("author"),
        F.lit("2025-04-16").alias("publish_date"),
        F.col("lang").alias("description"),
    )
    rows = doc.select(
        F.col("doc_id").alias("pos"),
        url.alias("url"),
        F.col("text").alias("markdown"),
        meta.alias("meta"),
        P.fetch_error(url, status, line).alias("error"),
        (F.col("doc_id") % 5 == 0).alias("cached"),
    )
    # Rows taken from a store come whole and without a full length.
    return truncate_markdown(rows.withColumn("whole", F.col("markdown")), max_len).select(
        "pos",
        "url",
        F.when(F.col("cached"), F.col("whole")).otherwise(F.col("markdown")).alias("markdown"),
        "meta",
        "error",
        "cached",
        (F.col("truncated") & ~F.col("cached")).alias("truncated"),
        F.when(F.col("cached"), 0).otherwise(F.col("full_length")).cast("bigint").alias("full_length"),
        F.when(F.col("cached"), F.col("full_length")).otherwise(F.col("length")).alias("length"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place the cluster shares."""
    return f"{shared_folder(spark)}/parchmill-{name}-{uuid.uuid4().hex}"


def _flat_results(results: DataFrame) -> DataFrame:
    return results.select(
        "pos",
        "url",
        "markdown",
        F.coalesce(F.col("meta.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("meta.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("error.code"), F.lit("")).alias("error_code"),
        "cached",
        "truncated",
        "full_length",
        "length",
    )


# --- sources and sinks --------------------------------------------------------


@query
def scan_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.col("url").alias("final_url"), F.octet_length("html").cast("bigint").alias("html_bytes"))


@query
def url_batch(spark, sf_dir):
    return P.url_batch(spark, pages(spark, sf_dir), order_by="page_id")


@query
def fetch_outcome(spark, sf_dir):
    log = P.fetch_outcome(fetch_log(pages(spark, sf_dir)))
    return log.select("page_id", "ok", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


@query
def write_store(spark, sf_dir):
    path = scratch(spark, "store")
    SS.write_store(stored_pages(spark, sf_dir), path, batch_id=0)
    return SS.read_store(spark, path).select("url_key", "url", "markdown", F.col("meta.title").alias("title"), F.unix_micros("stored_at").alias("stored_us"))


@query
def read_store(spark, sf_dir):
    """The layout of one JSON file per entry, some of them torn off."""
    path = scratch(spark, "json")
    store = stored_pages(spark, sf_dir)
    damaged = F.col("markdown").rlike("7$")
    SS.write_store_files(store.filter(~damaged), path)
    cut = F.concat(F.lit('{"url": "'), "url").alias("text")
    SS.append_texts(store.filter(damaged).select("url_key", cut), path)
    read = SS.read_store(spark, path, layout="json")
    return read.select("url_key", "url", "markdown", F.col("meta.title").alias("title"), F.unix_micros("fetched_at").alias("fetched_us"))


@query
def store_files(spark, sf_dir):
    """Statistics of a store of one file per entry, written twice: the second write replaces what it repeats."""
    path = scratch(spark, "files")
    store = stored_pages(spark, sf_dir)
    SS.write_store_files(store, path)
    SS.write_store_files(store.filter("url like '%3'").withColumn("markdown", F.concat(F.lit("newer "), "markdown")), path)
    return SS.store_file_stats(spark, path).withColumn("location", F.lit("store"))


@query
def store_files_clear(spark, sf_dir):
    path = scratch(spark, "filescleared")
    SS.write_store_files(stored_pages(spark, sf_dir), path)
    report = SS.store_clear(spark, path, layout="json")
    left = SS.store_file_stats(spark, path)
    return report.select("status", "entries_removed").crossJoin(F.broadcast(left.select(F.col("entries").alias("entries_left"))))


@query
def markdown_document(spark, sf_dir):
    return R.markdown_document(simple_results(spark, sf_dir), ROWS_PER_PART, PIECE_BYTES)


@query
def toon_document(spark, sf_dir):
    results = simple_results(spark, sf_dir)
    return R.toon_document(results, "url,title,length,cached,excerpt", RS.batch_stats(results), ROWS_PER_PART, PIECE_BYTES)


@query
def json_lines(spark, sf_dir):
    parsed = R.json_lines(simple_results(spark, sf_dir), "url,title,length,content")
    names = ["url", "title", "length", "content", "error", "code"]
    return parsed.select("pos", F.json_tuple("value", *names).alias(*names))


@query
def page_files(spark, sf_dir):
    return K.page_files(simple_results(spark, sf_dir)).select("pos", "filename")


@query
def saved_toon(spark, sf_dir):
    """Lines of a saved TOON dataset, counted by kind."""
    path = scratch(spark, "toon")
    K.save(simple_results(spark, sf_dir), path, "toon", "url,length,cached", aggregates=True)
    key = F.substring_index("value", ":", 1)
    return spark.read.text(path).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


# --- URLs and projections -----------------------------------------------------


@query
def valid_urls(spark, sf_dir):
    return P.split_valid(_spelled(spark, sf_dir))[0]


@query
def invalid_urls(spark, sf_dir):
    invalid = P.split_valid(_spelled(spark, sf_dir))[1]
    return invalid.select("pos", "url", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    kind = F.col("page_id") % 5
    spelled = (
        F.when(kind == 1, F.concat(F.upper(F.substring(url, 1, 4)), F.substr(url, F.lit(5))))
        .when(kind == 2, F.concat(F.lit("ftp"), url))
        .otherwise(url)
    )
    return pages(spark, sf_dir).select(F.col("page_id").alias("pos"), spelled.alias("url"))


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL in another spelling, with unsorted and encoded query keys."""
    extra = F.concat(F.lit("&z=1&a=%20b+c*~&m&a=2#top"))
    bare = F.substring_index("url", "#", 1)
    joined = F.when(F.contains(bare, F.lit("?")), bare).otherwise(F.concat(bare, F.lit("?k=v")))
    return pages(spark, sf_dir).select("page_id", F.concat(variant_url(joined), extra).alias("url"))


@query
def normalize_url(spark, sf_dir):
    messy = _messy(spark, sf_dir)
    landed = pages(spark, sf_dir).select("page_id", "url")
    return landed.unionByName(messy).select("page_id", "url", U.normalize_url(F.col("url")).alias("normal"))


@query
def url_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_key(F.col("url")).alias("key"))


@query
def filename_slug(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>([^<]*)", 1)
    return pages(spark, sf_dir).select("page_id", U.filename_slug(F.col("url"), title).alias("filename"))


@query
def select_fields(spark, sf_dir):
    return RS.select_fields(simple_results(spark, sf_dir), " url, title,author,published,nonsense,length,truncated", "pos")


@query
def ok_rows(spark, sf_dir):
    return RS.ok_rows(simple_results(spark, sf_dir)).select("pos", "url", "length")


@query
def failed_rows(spark, sf_dir):
    return RS.failed_rows(simple_results(spark, sf_dir)).select("pos", "url", F.col("error.code").alias("code"))


# --- extraction and conversion ------------------------------------------------


@query
def clean_html(spark, sf_dir):
    return X.clean_pages(pages(spark, sf_dir)).select("page_id", "html")


@query
def tag_tokens(spark, sf_dir):
    return X.tag_tokens(pages(spark, sf_dir)).select("page_id", "pos", "close", "tag", "text")


@query
def containers(spark, sf_dir):
    return X.containers(X.tag_tokens(pages(spark, sf_dir)))


@query
def drop_boilerplate(spark, sf_dir):
    return X.drop_boilerplate(X.tag_tokens(pages(spark, sf_dir))).select("page_id", "pos", "tag", "close")


@query
def main_content(spark, sf_dir):
    clean = X.partition_pages(pages(spark, sf_dir))
    best = X.main_content(X.container_tokens(clean))
    return best.select("page_id", "open_pos", "close_pos", "tag", F.round("score", 6).alias("score"))


@query
def page_metadata(spark, sf_dir):
    return X.page_metadata(pages(spark, sf_dir))


@query
def stated_metadata(spark, sf_dir):
    """Author, day and description in the forms a page may state them, around the number and words of each page."""
    forms = [
        '<meta name="author" content="A &amp; @"><meta property="article:published_time" content="2025-03-#T22:10:00-08:00">'
        '<meta name=description content=" About  @ "><meta property="og:description" content="other">',
        '<meta property=article:author content="Guild @"><meta name="date" content="2024-11-#"><meta property="og:description" content="Og &quot;@&quot;">',
        '<title>T@</title><p class="lead byline">By <b>@</b></p><time datetime="2023-07-#T01:02:03Z">then</time>',
        '<meta name="date" content="the #th of May"><meta name="author" content=""><div class="bylines">no @</div>',
    ]
    kind, day = F.col("page_id") % 4, F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    form = F.get(F.array(*map(F.lit, forms)), kind.cast("int"))
    head = F.replace(F.replace(form, F.lit("@"), F.col("page_id").cast("string")), F.lit("#"), day)
    stated = F.concat(F.lit("<html><head>"), head, F.lit("</head>"), F.regexp_replace("html", r"(?is)^.*?(?=<body\b|\z)|<meta\b[^>]*>", ""))
    return X.page_metadata(pages(spark, sf_dir).withColumn("html", stated)).select("page_id", "author", "publish_date", "description")


@query
def noise_by_share(spark, sf_dir):
    """Pages whose wrapper, article or headline is marked like noise, and pages with comments that are."""
    body, html = r"(?i)<body[^>]*>", F.col("html")
    site = '<body><header><h1>Site of all pages, with a long name</h1></header>'
    head = F.concat(F.lit("<article><header><h2>Head of "), F.col("page_id").cast("string"), F.lit("</h2>"))
    commented = F.replace(html, F.lit("<article>"), F.lit('<div class="post comments-open"><article>'))
    headed = F.replace(F.regexp_replace(html, body, site), F.lit("<article>"), head)
    forms = [
        F.regexp_replace(html, body, '<body><div class="site has-ads">'),
        F.replace(commented, F.lit("</article>"), F.lit("</article></div>")),
        F.replace(headed, F.lit("</h1><p>"), F.lit("</h1></header><p>")),
        F.concat(html, F.lit('<div class="comments"><p>One comment</p></div>')),
    ]
    landed = pages(spark, sf_dir).withColumn("html", F.get(F.array(*forms), (F.col("page_id") % 4).cast("int")))
    return X.main_html(landed).select("page_id", "fallback", "main_html")


@query
def extract_fallback(spark, sf_dir):
    """Every page; every page without its containers, so also without a body; and a page of a few words each."""
    landed = pages(spark, sf_dir)
    bare = landed.select(
        (-F.col("page_id") - 1).alias("page_id"),
        "url",
        F.regexp_replace("html", r"(?i)</?(?:article|main|section|div|td|body|nav|aside|footer|header)\b[^>]*>", "").alias("html"),
    )
    short = landed.select(
        (F.col("page_id") + 1_000_000_000).alias("page_id"),
        "url",
        F.concat(F.lit("<i>"), F.col("page_id").cast("string"), F.lit("</i> short")).alias("html"),
    )
    content = X.main_html(landed.select("page_id", "url", "html").unionByName(bare).unionByName(short))
    stated = F.col("stated.title")
    return content.select(
        "page_id",
        F.when(F.col("fallback") & (stated == ""), F.lit(X.UNTITLED)).otherwise(stated).alias("title"),
        "fallback",
        "main_html",
    )


@query
def convert_corpus(spark, sf_dir):
    return C.convert_corpus(pages(spark, sf_dir)).select("page_id", "body_md")


@query
def convert_rules(spark, sf_dir):
    """Marks and links around blocks, an unclosed mark, lists, quotes and code, around the number of each page."""
    html = (
        "<b><p>x@</p><p>y@ <i>z@</i></p></b><a href='/u@?a=1&copy=2'><h3>t@</h3></a><em><ul><li>a@</li><li>b@</li></ul></em>"
        "<p><b>o@ <br><p>n@ <mark>m@</mark> <code>c`@</code></p><ol start=7><li>q@<li>r@</ol><blockquote><p>k@</p></blockquote>"
        "<pre>``` @\n*</pre><hr><p># h@</p><p>@. l</p><img src=i@.png alt='A@'>&rarr; &frac12;&copy"
    )
    rows = pages(spark, sf_dir).select(
        "page_id",
        F.col("url").alias("final_url"),
        F.replace(F.lit(html), F.lit("@"), F.col("page_id").cast("string")).alias("html"),
    )
    return C.convert_html(rows).select("page_id", "body_md")


@query
def decode_entities(spark, sf_dir):
    """Every page with nine of all reference names: alone, running into a word, and in an address."""
    listed = F.split(F.lit(" ".join(sorted(html5))), " ")
    rows = pages(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    name = F.get(listed, ((F.col("page_id") * 9 + F.col("k")) % len(html5)).cast("int"))
    rows = rows.withColumn("name", name).withColumn("glued", F.concat(F.rtrim("name", F.lit(";")), F.lit("Zq")))
    closed = F.concat(F.lit("x&"), "name", F.lit(" y"))
    # An ampersand by reference stays one: nothing is decoded twice.
    address = F.concat(F.lit("?a=1&"), "glued", F.lit("=2&"), "name")
    return rows.select(
        "page_id",
        "k",
        H.decode_entities(closed).alias("alone"),
        H.decode_entities(F.concat(F.lit("&amp;lt;&"), "glued")).alias("glued"),
        H.decode_entities(address, in_attribute=True).alias("address"),
    )


@query
def front_matter(spark, sf_dir):
    results = simple_results(spark, sf_dir)
    return results.select("pos", C.front_matter(F.col("meta"), F.col("url")).alias("front"))


@query
def documents(spark, sf_dir):
    return C.documents(pages(spark, sf_dir), AS_OF).select(
        "page_id", "final_url", F.col("meta.title").alias("title"), F.col("meta.description").alias("description"), "markdown"
    )


@query
def repeated_page_ids(spark, sf_dir):
    """Pages that share an id stay pages of their own: each page, itself again, and a short one, all under one id."""
    landed = pages(spark, sf_dir).select("page_id", "url", "html")
    short = F.concat(F.lit("<title>S"), "page_id", F.lit("</title><p>short text of "), "page_id", F.lit("</p>"))
    rows = landed.unionByName(landed).unionByName(landed.withColumns({"html": short, "url": F.concat("url", F.lit("#s"))}))
    return C.documents(rows, AS_OF).select("page_id", "final_url", F.col("meta.title").alias("title"), "markdown")


# --- lengths ------------------------------------------------------------------


@query
def truncate_markdown_(spark, sf_dir):
    text = F.col("text")
    limits = (30, 200, 1000, 5000)
    return texts(spark, sf_dir).select(
        "doc_id",
        *[TX.truncated_length(text, m).alias(f"cut_{m}") for m in limits],
        TX.truncate(text, 200).alias("text_200"),
        TX.truncate(text, 1000).alias("text_1000"),
    )


@query
def excerpt(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", TX.excerpt(F.col("text")).alias("excerpt"))


@query
def content_length(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", TX.byte_length(F.col("text")).alias("length"))


@query
def truncation_flags(spark, sf_dir):
    cut = truncate_markdown(texts(spark, sf_dir).withColumnRenamed("text", "markdown"), MAX_LEN)
    return cut.select("doc_id", "full_length", "truncated", "length")


# --- store and batch ----------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_with_repeats(spark, sf_dir).select("pos", "url")


@query
def store_lookup(spark, sf_dir):
    found = S.store_lookup(_asked(spark, sf_dir), stored_pages(spark, sf_dir), AS_OF)
    return found.select("pos", "url", "markdown", "cached", "truncated", "full_length")


@query
def store_hits(spark, sf_dir):
    return S.store_hits(_asked(spark, sf_dir), stored_pages(spark, sf_dir), AS_OF).select("pos", "url")


@query
def store_misses(spark, sf_dir):
    return S.store_misses(_asked(spark, sf_dir), stored_pages(spark, sf_dir), AS_OF).select("pos", "url")


@query
def batch_duplicates(spark, sf_dir):
    log = batch_with_repeats(spark, sf_dir)
    results = log.select(
        "pos",
        "url",
        F.concat(F.lit("text of "), "url").alias("markdown"),
        F.struct(F.lit("t").alias("title")).alias("meta"),
        P.fetch_error(F.col("url"), F.col("status"), F.col("status_line")).alias("error"),
        F.lit(False).alias("cached"),
        F.lit(False).alias("truncated"),
        F.octet_length(F.concat(F.lit("text of "), "url")).cast("bigint").alias("full_length"),
    )
    done = RS.batch_duplicates(results)
    return done.select("pos", "url", "markdown", F.col("error.code").alias("code"), "cached", "full_length")


@query
def assemble_results(spark, sf_dir):
    batch = process_batch(batch_with_repeats(spark, sf_dir), AS_OF, stored_pages(spark, sf_dir), max_len=MAX_LEN)
    return _flat_results(batch.results)


@query
def no_cache_run(spark, sf_dir):
    batch = process_batch(batch_with_repeats(spark, sf_dir), AS_OF, stored_pages(spark, sf_dir), max_len=MAX_LEN, no_cache=True)
    return _flat_results(batch.results)


@query
def store_upsert(spark, sf_dir):
    store = stored_pages(spark, sf_dir)
    newer = store.withColumns(
        {"markdown": F.concat(F.lit("newer "), "url"), "stored_at": F.lit("2026-01-02 12:00:00").cast("timestamp")}
    )
    return S.store_upsert(store, newer.select(*STORE.names)).select(
        "url_key", "markdown", F.unix_micros("stored_at").alias("stored_us")
    )


@query
def store_stats(spark, sf_dir):
    return S.store_stats(stored_pages(spark, sf_dir), "store")


@query
def store_clear(spark, sf_dir):
    path = scratch(spark, "cleared")
    SS.write_store(stored_pages(spark, sf_dir), path)
    report = SS.store_clear(spark, path)
    left = SS.read_store(spark, path).agg(F.count(F.lit(1)))
    return report.select("status", "entries_removed", left.scalar().alias("entries_left"))


@query
def store_compact(spark, sf_dir):
    """A store compacted to a new place, and a batch appended there."""
    path = scratch(spark, "loose")
    store = stored_pages(spark, sf_dir)
    newer = store.withColumns(
        {"markdown": F.concat(F.lit("newer "), "url"), "stored_at": F.lit("2026-01-02 12:00:00").cast("timestamp")}
    )
    SS.write_store(store, path, batch_id=0)
    SS.write_store(newer, path, batch_id=1)
    target = scratch(spark, "compact")
    SS.compact_store(SS.read_store(spark, path), target)
    SS.write_store(store.withColumn("markdown", F.concat(F.lit("appended "), "url")), target, batch_id=2)
    return SS.read_store(spark, target).select("url_key", "markdown", F.unix_micros("stored_at").alias("stored_us"))


@query
def store_snapshot(spark, sf_dir):
    """Look-ups in a bucketed store: two writes, a compaction, one write replayed after it, and a late one."""
    path = scratch(spark, "snapshots")
    store = stored_pages(spark, sf_dir)
    renewed = pages(spark, sf_dir).filter("page_id % 3 = 0").select(U.url_key(F.col("url")).alias("url_key")).distinct()
    newer = store.join(renewed, "url_key", "left_semi").withColumns(
        {"markdown": F.concat(F.lit("newer "), "url"), "stored_at": F.lit("2026-01-03 06:00:00").cast("timestamp")}
    )
    SN.write_entries(store, path, "first")
    SN.write_entries(newer, path, "second")
    SN.compact_snapshot(spark, path)
    SN.write_entries(newer, path, "second")
    late = newer.withColumns({"markdown": F.concat(F.lit("late "), "url"), "stored_at": F.lit("2026-01-01").cast("timestamp")})
    SN.write_entries(late, path, "late")
    found = S.store_lookup(_asked(spark, sf_dir), SN.read_snapshot(spark, path), AS_OF)
    return found.select("pos", "url", "markdown", "cached")


@query
def store_replay(spark, sf_dir):
    """The store after one batch has run twice."""
    path = scratch(spark, "replayed")
    landed = pages(spark, sf_dir).select(F.col("page_id").alias("pos"), "url", "html")
    for _ in range(2):
        process_into_store(landed, path, "2026-01-03", AS_OF)
    return SS.read_store(spark, path).select("url_key", "url", "markdown")


@query
def expired_entries(spark, sf_dir):
    return S.expired_entries(stored_pages(spark, sf_dir), AS_OF).select("url_key", F.unix_micros("stored_at").alias("stored_us"))


@query
def format_bytes(spark, sf_dir):
    sizes = texts(spark, sf_dir).select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    return sizes.select(
        "doc_id",
        TX.format_bytes(F.col("n")).alias("small"),
        TX.format_bytes(F.col("n") * 1024).alias("medium"),
        TX.format_bytes(F.col("n") * 1048576 * 1024).alias("large"),
    )


# --- statistics and errors ----------------------------------------------------


@query
def batch_stats(spark, sf_dir):
    return RS.batch_stats(simple_results(spark, sf_dir, MAX_LEN))


@query
def batch_stats_by_host(spark, sf_dir):
    hosted = simple_results(spark, sf_dir, MAX_LEN).withColumn("host", U.url_host(F.col("url")))
    return RS.batch_stats(hosted, ["host"])


@query
def batch_stats_toon(spark, sf_dir):
    return R.batch_stats_toon(RS.batch_stats(simple_results(spark, sf_dir, MAX_LEN)))


@query
def error_rows(spark, sf_dir):
    detail = F.concat(F.lit("row "), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 4
    error = (
        F.when(kind == 0, E.error_struct(E.GENERIC, F.col("url"), detail))
        .when(kind == 1, E.error_struct(E.FETCH, F.col("url"), detail))
        .when(kind == 2, E.error_struct(E.EXTRACTION, F.col("url"), detail))
        .otherwise(E.cache_error(F.lit("get"), detail))
    )
    return pages(spark, sf_dir).select("page_id", error.alias("e")).select("page_id", "e.*")


@query
def error_text(spark, sf_dir):
    rows = error_rows(spark, sf_dir)
    return rows.select("page_id", E.error_text(F.struct("code", "message", "url", "context")).alias("line"))


@query
def errors_by_class(spark, sf_dir):
    rows = error_rows(spark, sf_dir)
    return RS.errors_by_class(rows.select(F.struct("code", "message", "url", "context").alias("error")))


# --- TOON ---------------------------------------------------------------------


@query
def toon_records(spark, sf_dir):
    return R.toon_records(RS.ok_rows(simple_results(spark, sf_dir)), "url,title,date,length,cached,content")


@query
def toon_table(spark, sf_dir):
    doc = texts(spark, sf_dir).withColumnRenamed("doc_id", "pos")
    return R.toon_table(doc, ["lang", "n_chars", "text"], ["source"], ROWS_PER_PART, PIECE_BYTES)


@query
def toon_list(spark, sf_dir):
    listed = texts(spark, sf_dir).select("doc_id", F.split("text", r"\s+").alias("words"))
    return listed.select("doc_id", TN.toon_list(F.col("words"), T.ArrayType(T.StringType())).alias("toon"))


@query
def toon_quote(spark, sf_dir):
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "line"))
    return lines.select("doc_id", "i", TN.toon_string(F.col("line")).alias("toon"))


@query
def toon_number(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        TN.toon_number(F.col("value"), T.DoubleType()).alias("value"),
        TN.toon_number(F.col("user_id"), T.LongType()).alias("user_id"),
    )


@query
def toon_nested(spark, sf_dir):
    doc = texts(spark, sf_dir).select(
        "doc_id",
        F.struct(
            F.col("lang"),
            F.struct(F.col("source"), F.col("n_chars"), (F.col("n_chars") > 500).alias("long")).alias("about"),
            F.create_map(F.lit("whole-text"), F.col("text")).alias("words"),
        ).alias("doc"),
    )
    return doc.select("doc_id", TN.toon_value(F.col("doc"), doc.schema["doc"].dataType).alias("toon"))


# --- streaming ----------------------------------------------------------------


@query
def stream_documents(spark, sf_dir):
    """Pages landing as files, converted by a stream."""
    source = pages(spark, sf_dir)
    target = scratch(spark, "stream")
    landing = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/pages.parquet*")
    run = Y.stream_documents(
        landing.withColumnRenamed("page_id", "pos"),
        AS_OF,
        lambda results, batch_id: results.write.mode("overwrite").parquet(f"{target}/out/batch={batch_id}"),
        f"{target}/checkpoint",
        max_len=MAX_LEN,
    )
    run.awaitTermination()
    return _flat_results(spark.read.parquet(f"{target}/out"))


@query
def stream_first_seen(spark, sf_dir):
    """The first event of each user within a year."""
    source = events(spark, sf_dir)
    target = scratch(spark, "first")
    landing = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    run = (
        Y.stream_first_seen(landing, "user_id", "ts", "365 days")
        .select("user_id")
        .writeStream.format("parquet")
        .option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{target}/out")


@query
def stream_first_within(spark, sf_dir):
    """Events of each user that no earlier one covers for two days, by a stream over all of them."""
    source = events(spark, sf_dir)
    target = scratch(spark, "within")
    # A row without a user, later than all others, closes the source.
    closing = source.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    closing.select(*[F.col(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]).write.parquet(
        f"{target}/closing"
    )
    landing = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    closed = landing.unionByName(spark.readStream.schema(source.schema).parquet(f"{target}/closing"))
    run = (
        Y.stream_first_within(closed.select("user_id", "ts"), "user_id", "ts", "2 days")
        .writeStream.format("parquet")
        .option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{target}/out").select("user_id", F.unix_micros("ts").alias("seen_us"))


@query
def stream_upsert(spark, sf_dir):
    """A page store fed by a stream."""
    source = pages(spark, sf_dir)
    target = scratch(spark, "upsert")
    landing = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/pages.parquet*")
    run = Y.stream_upsert(
        spark, landing.withColumnRenamed("page_id", "pos"), f"{target}/store", AS_OF, f"{target}/checkpoint"
    )
    run.awaitTermination()
    return SS.read_store(spark, f"{target}/store").select("url_key", "url", "markdown")


# --- flagship -----------------------------------------------------------------


def clean_documents_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean documents of all pages, cut to size, and their statistics per host."""
    log = fetch_log(pages(prepare(spark), sf_dir)).withColumnRenamed("page_id", "pos")
    results = process_batch(log, AS_OF, max_len=MAX_LEN, ordered=False).results
    return RS.batch_stats(results.withColumn("host", F.lower(U.url_host(F.col("url")))), ["host"])


@query
def corpus_stats_by_host(spark, sf_dir):
    return clean_documents_by_host(spark, sf_dir)
