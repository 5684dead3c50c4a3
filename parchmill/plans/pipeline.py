"""The batch job: landed pages in, result rows and store entries out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions import errors as E
from parchmill.functions.text import byte_length, is_cut, truncate, truncated_length
from parchmill.operators.convert import documents
from parchmill.operators.results import assemble, with_source
from parchmill.operators.skew import skew_join
from parchmill.operators.membership import likely
from parchmill.operators.store import AsOf, asked_entries, fresh_keys, in_buckets, with_key
from parchmill.schemas import METADATA
from parchmill.session import cut_lineage, written
from parchmill.sources.pages import fetch_error, final_url_error, split_valid
from parchmill.sources import snapshots
from parchmill.sources.store import read_store, store_rows, write_store


@dataclass
class Batch:
    """``results`` in batch order, and the ``entries`` to add to the store."""

    results: DataFrame
    entries: DataFrame


def truncate_markdown(df: DataFrame, max_len: int | None, full: bool = False) -> DataFrame:
    """Cut ``markdown`` of freshly converted rows and add the length columns."""
    text = F.col("markdown")
    return df.withColumns(
        {
            "full_length": byte_length(text),
            "truncated": is_cut(text, max_len, full),
            "length": truncated_length(text, max_len, full),
            "markdown": truncate(text, max_len, full),
        }
    )


def _with_errors(landed: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Batch rows without HTML: the valid ones with what went wrong, and the invalid ones."""
    final_url = F.coalesce("final_url", "url") if "final_url" in landed.columns else F.col("url")
    error = final_url_error(F.col("url"), F.col("final_url"))
    rows = landed.select(
        "pos",
        "url",
        final_url.alias("final_url"),
        *[c for c in ("status", "status_line") if c in landed.columns],
    )
    if "status" in rows.columns:
        error = F.coalesce(fetch_error(F.col("url"), F.col("status"), F.col("status_line")), error)
    valid, invalid = split_valid(rows, strict)
    return (
        valid.select("pos", "url", error.alias("error")),
        invalid.select("pos", "url", F.col("error").cast(E.ERROR_TYPE).alias("error")),
    )


def _failed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "pos",
        "url",
        F.lit("").alias("markdown"),
        F.lit(None).cast(METADATA).alias("meta"),
        "error",
        F.lit(False).alias("cached"),
        F.lit(False).alias("truncated"),
        F.lit(0).cast("bigint").alias("full_length"),
        F.lit(0).cast("bigint").alias("length"),
    )


def process_batch(
    landed: DataFrame,
    as_of: AsOf,
    store: DataFrame | None = None,
    ttl: dt.timedelta | None = None,
    max_len: int | None = None,
    full: bool = False,
    no_cache: bool = False,
    strict: bool = False,
    ordered: bool = False,
) -> Batch:
    """Convert a batch of landed pages (``pos, url, html[, final_url, status, status_line]``).

    Store hits, failures and repeated URLs are settled on rows without HTML,
    which are checkpointed; only the pages that really need it are cleaned,
    shuffled and converted, once per key. Converted pages are written once, to
    the shared folder, when the function is called: results, entries, statistics
    and whatever is saved read that copy and convert nothing. ``ordered`` sorts
    the results over the whole batch; sinks put them in order by themselves.
    """
    valid, invalid = _with_errors(landed, strict)
    rows = cut_lineage(with_key(valid))
    use_store = store is not None and not no_cache

    parts = [_failed(invalid)]
    if use_store:
        # Which keys are fresh is known from the keys alone; Markdown is fetched for hits only.
        keys = fresh_keys(likely(in_buckets(store, rows), rows, "url_key", rows.count()), as_of, ttl)
        looked_up = cut_lineage(skew_join(rows, keys.withColumn("hit", F.lit(True)), "url_key"))
        hits = looked_up.filter(F.col("hit")).drop("hit", "error")
        rows = looked_up.filter(F.col("hit").isNull()).drop("hit")
        fresh = asked_entries(store, hits, as_of, ttl)
        found = skew_join(hits, fresh.select("url_key", "markdown", "meta"), "url_key", "inner")
        parts.append(
            found.select(
                "pos",
                "url",
                "markdown",
                "meta",
                E.no_error().alias("error"),
                F.lit(True).alias("cached"),
                F.lit(False).alias("truncated"),
                F.lit(0).cast("bigint").alias("full_length"),
                byte_length(F.col("markdown")).alias("length"),
            )
        )

    sourced = rows.withColumn("source_pos", F.col("pos")) if no_cache else cut_lineage(with_source(rows))
    is_own = F.col("source_pos") == F.col("pos")
    own = sourced.filter(is_own & F.col("error").isNull())
    parts.append(_failed(sourced.filter(is_own & F.col("error").isNotNull())))

    pages = landed.withColumnRenamed("pos", "page_id")
    converted = documents(pages, as_of, own.select(F.col("pos").alias("page_id"))).select(
        F.col("page_id").alias("source_pos"), "markdown", "meta"
    )
    converted = written(converted, "converted")
    wanted = sourced.filter(F.col("error").isNull() | ~is_own).select("pos", "url", "source_pos")
    copied = F.col("source_pos") < F.col("pos")
    # Without repeats every position is asked for once.
    joined = wanted.join(converted, "source_pos") if no_cache else skew_join(wanted, converted, "source_pos", "inner")
    cut = truncate_markdown(joined.withColumnRenamed("markdown", "whole").withColumn("markdown", F.col("whole")), max_len, full)
    parts.append(
        cut.select(
            "pos",
            "url",
            F.when(copied, F.col("whole")).otherwise(F.col("markdown")).alias("markdown"),
            "meta",
            E.no_error().alias("error"),
            copied.alias("cached"),
            (F.col("truncated") & ~copied).alias("truncated"),
            F.when(copied, 0).otherwise(F.col("full_length")).cast("bigint").alias("full_length"),
            F.when(copied, F.col("full_length")).otherwise(F.col("length")).alias("length"),
        )
    )
    own_documents = joined.filter(~copied).select("url", "markdown", "meta")
    return Batch(assemble(*parts, ordered=ordered), store_rows(own_documents, as_of))


def process_into_store(
    landed: DataFrame, store_path: str, batch_id: int | str, as_of: AsOf, layout: str = "batches", **options
) -> Batch:
    """``process_batch`` against a store on disk, and its entries written there as batch ``batch_id``.

    The batch never looks up what it wrote itself, and its results never read
    it, so running it again gives the same store and the same results. With
    ``layout="snapshots"`` the store is one of ``sources.snapshots``: look-ups
    read the buckets of the batch's keys.
    """
    spark = landed.sparkSession
    if layout == "snapshots":
        known = snapshots.read_snapshot(spark, store_path, without_label=batch_id)
    else:
        known = read_store(spark, store_path, without_batch=batch_id)
    batch = process_batch(landed, as_of, known, **options)
    if layout == "snapshots":
        snapshots.write_entries(batch.entries, store_path, batch_id)
    else:
        write_store(batch.entries, store_path, batch_id)
    return batch
