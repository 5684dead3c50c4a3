"""The page store: look-up with an age limit, upsert, statistics, clearing.

A store is a DataFrame of entries (see ``schemas.STORE``). Writing appends;
the newest entry of a key counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.text import byte_length, format_bytes
from parchmill.functions.urls import url_key
from parchmill.operators.convert import as_of_column
from parchmill.operators.membership import likely
from parchmill.operators.skew import skew_join
from parchmill.session import cut_lineage

DEFAULT_TTL = dt.timedelta(hours=24)

AsOf = dt.datetime | str | Column


def _oldest_allowed(as_of: AsOf, ttl: dt.timedelta | None) -> Column:
    ttl = ttl or DEFAULT_TTL
    return as_of_column(as_of) - F.lit(ttl)


def latest_entries(store: DataFrame) -> DataFrame:
    """The newest entry of each key.

    An aggregate rather than a window: copies of a hot key collapse before the
    shuffle instead of meeting in one task.
    """
    others = [c for c in store.columns if c != "url_key"]
    newest = F.max_by(F.struct(*others), F.struct("stored_at", "markdown"))
    return store.groupBy("url_key").agg(newest.alias("entry")).select("url_key", "entry.*")


def fresh_entries(store: DataFrame, as_of: AsOf, ttl: dt.timedelta | None = None) -> DataFrame:
    """The newest entry of each key, unless it is older than ``ttl``.

    The age test comes first, where the scan can use it: if any entry of a key
    is young enough, its newest one is.
    """
    return latest_entries(store.filter(F.col("stored_at") >= _oldest_allowed(as_of, ttl)))


def asked_entries(store: DataFrame, keys: DataFrame, as_of: AsOf, ttl: dt.timedelta | None = None) -> DataFrame:
    """The newest entry of each of ``keys`` (``url_key``), unless it is older than ``ttl``.

    Which entries win is found on keys and times alone; then their Markdown is
    fetched, by a filter that stands before the exchange, so no other entry's
    Markdown crosses the network but for a few. Of a store with buckets, only
    those of the keys are read. The keys and the winners are checkpointed, so
    part of the work runs when the function is called.
    """
    asked = cut_lineage(keys.select("url_key").filter(F.col("url_key").isNotNull()).distinct())
    young = in_buckets(store, asked).filter(F.col("stored_at") >= _oldest_allowed(as_of, ttl))
    slim = likely(young.select("url_key", "stored_at"), asked, "url_key", asked.count())
    newest = slim.join(asked, "url_key", "left_semi").groupBy("url_key").agg(F.max("stored_at").alias("stored_at"))
    newest = cut_lineage(newest)
    winner = ["url_key", "stored_at"]
    # Entries of one key and one time are left to the rule for all entries.
    return latest_entries(likely(young, newest, winner, newest.count()).join(newest, winner, "left_semi"))


def in_buckets(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Of a store with ``bucket``s (``sources.snapshots``), those that ``keys`` fall into: one number each, 256 at most."""
    if "bucket" not in store.columns:
        return store
    digits = F.conv(F.substring("url_key", 1, 2), 16, 10).cast("int")
    held = [r[0] for r in keys.select(digits.alias("bucket")).distinct().collect()]
    return store.filter(F.col("bucket").isin(held)).drop("bucket")


def expired_entries(store: DataFrame, as_of: AsOf, ttl: dt.timedelta | None = None) -> DataFrame:
    """Entries strictly older than ``ttl``; look-ups ignore them, compaction may drop them."""
    return store.filter(F.col("stored_at") < _oldest_allowed(as_of, ttl))


def with_key(urls: DataFrame) -> DataFrame:
    return urls if "url_key" in urls.columns else urls.withColumn("url_key", url_key(F.col("url")))


def fresh_keys(store: DataFrame, as_of: AsOf, ttl: dt.timedelta | None) -> DataFrame:
    return store.filter(F.col("stored_at") >= _oldest_allowed(as_of, ttl)).select("url_key").distinct()


def store_lookup(urls: DataFrame, store: DataFrame, as_of: AsOf, ttl: dt.timedelta | None = None) -> DataFrame:
    """Every URL with its stored document, if a fresh one exists.

    A hit returns the stored Markdown whole, keeps the URL as asked for, and
    counts as cached with a full length of 0.
    """
    asked = with_key(urls)
    found = asked_entries(store, asked, as_of, ttl).select("url_key", "markdown", "meta", F.lit(True).alias("hit"))
    joined = skew_join(asked, found, "url_key")
    return joined.withColumns(
        {
            "cached": F.coalesce("hit", F.lit(False)),
            "truncated": F.lit(False),
            "full_length": F.lit(0).cast("bigint"),
            "length": byte_length(F.col("markdown")),
        }
    ).drop("hit")


def store_hits(urls: DataFrame, store: DataFrame, as_of: AsOf, ttl: dt.timedelta | None = None) -> DataFrame:
    return skew_join(with_key(urls), fresh_keys(store, as_of, ttl), "url_key", "left_semi")


def store_misses(urls: DataFrame, store: DataFrame, as_of: AsOf, ttl: dt.timedelta | None = None) -> DataFrame:
    """URLs that still need conversion; the costly stages see only these."""
    return skew_join(with_key(urls), fresh_keys(store, as_of, ttl), "url_key", "left_anti")


def store_upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Store with ``fresh`` entries merged in; the last write of a key wins."""
    return latest_entries(store.unionByName(fresh))


def store_stats(store: DataFrame, location: str) -> DataFrame:
    """Entries, total size and mean size (absent without entries), expired ones included."""
    sizes = store.select(byte_length(F.col("markdown")).alias("size"))
    totals = sizes.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes")
    )
    return store_totals(totals, location)


def store_totals(totals: DataFrame, location: str) -> DataFrame:
    """The report of a store from one row of its ``entries`` and ``bytes``."""
    mean = F.when(F.col("entries") > 0, F.expr("bytes div entries"))
    return totals.select(
        "entries",
        format_bytes(F.col("bytes")).alias("total_size"),
        format_bytes(mean).alias("average_entry_size"),
        F.lit(location).alias("location"),
    )


def clear_report(removed: Column, location: str, exists: bool = True) -> list[Column]:
    """Columns of the one-row report of clearing a store."""
    return [
        F.when(removed > 0, F.lit("cleared")).otherwise(F.lit("already_empty")).alias("status"),
        removed.alias("entries_removed"),
        F.lit(location).alias("location"),
        F.lit(None if exists else "directory_does_not_exist").cast("string").alias("reason"),
    ]
