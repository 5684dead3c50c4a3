"""Exact duplicates: a Bloom pass finds what may repeat, and only that shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm import bitmaps as B
from parchmill.llm.common import join_totals, staged


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty.

    Single spaces are left alone by the pattern, as replacing them changes nothing.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal_text(text), 256))


def _suspects(keys: DataFrame) -> tuple[DataFrame, int]:
    bits = B.filter_bits(keys.count())
    return staged(B.repeated(keys, "key", bits), "repeated"), bits


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Pass 1 counts the cells of two hash functions and keeps, as a filter, those
    hit at least twice. Pass 2 tests every row: one whose key cannot repeat
    passes straight through; the rest is grouped by its SHA-256, which decides.
    The filter has a fixed largest size and steers only what shuffles.

    Null and empty texts, and texts of white space of the same normal form, are
    equal to each other like any others. A row is kept if its doc_id is the
    smallest of its group: rows that repeat a doc_id with the same text are one
    document and stay or go together. Null ids count as larger than any other;
    a group of null ids only is kept whole. An empty table gives no rows.
    """
    keys = staged(docs.select("doc_id", digest(F.col("text")).alias("key")), "digests")
    pieces, bits = _suspects(keys)
    tested = B.flagged(keys, "key", pieces, bits, "suspect")
    suspects = staged(tested.filter("suspect").select("doc_id", "key"), "suspects")
    totals = suspects.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_totals(suspects, totals, "key", "group_size", suspects.count())
    single = tested.filter("not suspect").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return grouped.select(*single.columns).unionByName(single).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose text cannot repeat are passed on where they are read; only the
    suspects meet the decision on their group. Same rules as ``mark_duplicates``.
    """
    keys = staged(docs.select("doc_id", digest(F.col("text")).alias("key")), "digests")
    pieces, bits = _suspects(keys)
    suspects = staged(B.flagged(keys, "key", pieces, bits, "suspect").filter("suspect").select("doc_id", "key"), "suspects")
    keep = suspects.groupBy("key").agg(F.min("doc_id").alias("keep_id"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("key"))
    tested = B.flagged(whole, "key", pieces, bits, "suspect")
    stay = tested.filter("suspect").join(
        keep.withColumnRenamed("key", "group"), (F.col("key") == F.col("group")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi"
    )
    return tested.filter("not suspect").select("row.*").unionByName(stay.select("row.*"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of ``docs`` for each normal text, with all its columns: that of the smallest doc_id, null last.

    Rows that repeat a doc_id or have none are copies like any others. Suspects
    are staged with a number of their own, by which one of rows with the same
    doc_id stays; rows whose text cannot repeat are passed on where they are read.
    An empty table gives no rows.
    """
    keys = staged(docs.select(digest(F.col("text")).alias("key")), "digests")
    pieces, bits = _suspects(keys)
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("key"))
    tested = B.flagged(whole, "key", pieces, bits, "suspect")
    suspects = staged(tested.filter("suspect").select("row", "id", "key", F.monotonically_increasing_id().alias("at")), "suspects")
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "at")
    keep = suspects.groupBy("key").agg(F.min(first).alias("first")).select("first.at")
    stay = suspects.join(keep, "at", "left_semi")
    return tested.filter("not suspect").select("row.*").unionByName(stay.select("row.*"))
