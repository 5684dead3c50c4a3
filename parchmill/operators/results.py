"""Result rows: duplicates inside a batch, assembly, field selection, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.errors import error_class
from parchmill.functions.text import byte_length, excerpt
from parchmill.operators.skew import skew_join
from parchmill.operators.store import with_key
from parchmill.schemas import RESULT
from parchmill.session import cut_lineage

DEFAULT_FIELDS = ["url", "title", "length", "cached"]


def ok_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNull())


def failed_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull())


def with_source(batch: DataFrame) -> DataFrame:
    """Add ``source_pos``: where a row's document comes from.

    ``batch`` has ``pos, url_key, error``. A row after the first success of its
    key takes that document; any other row is its own source. Only keys that
    occur twice enter the join, as one row each.
    """
    succeeded = F.when(F.col("error").isNull(), F.col("pos"))
    repeated = (
        batch.filter(F.col("url_key").isNotNull())
        .groupBy("url_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(succeeded).alias("first_ok"))
        .filter((F.col("copies") > 1) & F.col("first_ok").isNotNull())
        .drop("copies")
    )
    later = F.col("pos") > F.col("first_ok")
    return (
        skew_join(batch, repeated, "url_key")
        .withColumn("source_pos", F.when(later, F.col("first_ok")).otherwise(F.col("pos")))
        .drop("first_ok")
    )


def batch_duplicates(results: DataFrame) -> DataFrame:
    """Let later rows of a key take the first success of the batch.

    They get its full Markdown and metadata and count as cached; failures
    before it stay failures. ``results`` carry the untruncated document.
    """
    keyed = with_key(results)
    # Settled on slim rows, which are checkpointed: the joins look at their keys more than once.
    rows = cut_lineage(with_source(cut_lineage(keyed.select("pos", "url", "url_key", "error"))))
    documents = keyed.select(
        F.col("pos").alias("source_pos"), "markdown", "meta", "cached", "truncated", "full_length"
    )
    joined = skew_join(rows, documents, "source_pos")
    copied = F.col("source_pos") < F.col("pos")
    return joined.select(
        "pos",
        "url",
        "markdown",
        "meta",
        F.when(~copied, F.col("error")).alias("error"),
        (copied | F.col("cached")).alias("cached"),
        F.when(copied, False).otherwise(F.col("truncated")).alias("truncated"),
        F.when(copied, 0).otherwise(F.col("full_length")).cast("bigint").alias("full_length"),
        byte_length(F.col("markdown")).alias("length"),
    )


def assemble(*parts: DataFrame, ordered: bool = False) -> DataFrame:
    """Hits, converted rows and failures in one table, in batch order."""
    names = RESULT.names
    whole = reduce(DataFrame.unionByName, [p.select(*names) for p in parts])
    return whole.orderBy("pos") if ordered else whole


# --- fields -------------------------------------------------------------------


def field_columns() -> dict[str, Column]:
    """Output fields by name; ``published`` is another name for ``date``."""
    markdown = F.col("markdown")
    return {
        "url": F.col("url"),
        "title": F.col("meta.title"),
        "author": F.col("meta.author"),
        "date": F.col("meta.publish_date"),
        "published": F.col("meta.publish_date"),
        "description": F.col("meta.description"),
        "length": F.col("length"),
        "cached": F.col("cached"),
        "truncated": F.col("truncated"),
        "excerpt": excerpt(markdown),
        "content": markdown,
    }


def parse_fields(fields: str | Sequence[str] | None) -> list[str]:
    """Field names, trimmed; unknown and repeated ones are ignored."""
    if not fields:
        return list(DEFAULT_FIELDS)
    names = fields.split(",") if isinstance(fields, str) else fields
    known = field_columns()
    return list(dict.fromkeys(n.strip() for n in names if n.strip() in known))


def select_fields(results: DataFrame, fields: str | Sequence[str] | None = None, *keep: str) -> DataFrame:
    """Project results to output fields; what is not asked for is never computed."""
    columns = field_columns()
    return results.select(*keep, *[columns[name].alias(name) for name in parse_fields(fields)])


# --- statistics ---------------------------------------------------------------

STATS_FIELDS = ["total", "success", "failed", "cache_hits", "total_length", "average_length", "truncated_count"]


def batch_stats(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Seven counts over a batch, or per group, in one partial and final aggregate."""
    ok = F.col("error").isNull()
    length = F.when(F.col("full_length") > 0, F.col("full_length")).otherwise(F.coalesce("length", F.lit(0)))
    sums = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col("cached")).alias("cache_hits"),
        F.coalesce(F.sum(F.when(ok, length)), F.lit(0)).cast("bigint").alias("total_length"),
        F.count_if(ok & F.col("truncated")).alias("truncated_count"),
    )
    mean = F.when(F.col("success") > 0, F.expr("total_length div success")).otherwise(F.lit(0)).cast("bigint")
    return sums.withColumn("average_length", mean).select(*by, *STATS_FIELDS)


def errors_by_class(results: DataFrame) -> DataFrame:
    """Failures per error code and class."""
    return failed_rows(results).groupBy(
        F.col("error.code").alias("code"), error_class(F.col("error.code")).alias("error_class")
    ).agg(F.count(F.lit(1)).alias("failures"))
