"""Sinks: ordered text datasets, JSON Lines, one file per page.

Text goes out as range-ordered part files. Read in name order they are the
document; nothing is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions.urls import filename_slug
from parchmill.operators.render import ARTICLE_SEPARATOR, json_lines, markdown_articles, toon_blocks
from parchmill.operators.results import batch_stats, ok_rows
from parchmill.operators.skew import skew_join
from parchmill.operators.store import with_key

FORMATS = ("toon", "json", "markdown")


def _write_ordered(rows: DataFrame, path: str) -> None:
    """Write ``text`` in ``pos`` order; the writer ends each row with a newline."""
    rows.repartitionByRange("pos").sortWithinPartitions("pos").select("text").write.mode("overwrite").text(path)


def write_markdown(results: DataFrame, path: str) -> None:
    """The Markdown document; the newline after a row opens the next separator."""
    inner = ARTICLE_SEPARATOR.removeprefix("\n")
    text = F.when(
        F.col("text").startswith(ARTICLE_SEPARATOR),
        F.concat(F.lit(inner), F.substr(F.col("text"), F.lit(len(ARTICLE_SEPARATOR) + 1))),
    ).otherwise(F.col("text"))
    _write_ordered(markdown_articles(results).withColumn("text", text), path)


def write_toon(
    results: DataFrame, path: str, fields: str | Sequence[str] | None = None, aggregates: bool = False
) -> None:
    stats = batch_stats(results) if aggregates else None
    _write_ordered(toon_blocks(results, fields, stats).withColumnRenamed("toon", "text"), path)


def write_json(results: DataFrame, path: str, fields: str | Sequence[str] | None = None) -> None:
    _write_ordered(json_lines(results, fields).withColumnRenamed("value", "text"), path)


def page_files(results: DataFrame) -> DataFrame:
    """Successful rows with the file name each is stored under.

    Where several share a slug, all but one get their key in front. The owner
    of a slug is an aggregate, so a slug shared by many pages stays cheap.
    """
    named = with_key(ok_rows(results)).withColumn("slug", filename_slug(F.col("url"), F.col("meta.title")))
    owner = named.groupBy("slug").agg(F.min(F.struct("url_key", "pos")).alias("owner"))
    keyed = skew_join(named, owner, "slug")
    is_owner = F.struct("url_key", "pos") == F.col("owner")
    other = F.concat(F.substring("url_key", 1, 16), F.lit("-"), F.col("pos").cast("string"), F.lit("-"), F.col("slug"))
    return keyed.select("pos", "url", F.when(is_owner, F.col("slug")).otherwise(other).alias("filename"), "markdown")


def write_page_files(results: DataFrame, path: str) -> None:
    """A folder ``filename=<name>`` per page, holding one text file with the page's bytes.

    Pages are spread by name first, so a task has few folders open at once. The
    writer ends the text with a newline; a page's own last one is left to it.
    """
    text = F.regexp_replace("markdown", r"\n\z", "")
    page_files(results).select("filename", text.alias("text")).repartition("filename").sortWithinPartitions("filename").write.mode("overwrite").partitionBy("filename").text(path)


def save(
    results: DataFrame,
    path: str,
    format: str | None = None,
    fields: str | Sequence[str] | None = None,
    aggregates: bool = False,
) -> None:
    """Write results as Markdown (the default when saving), TOON or JSON."""
    chosen = format or "markdown"
    if chosen not in FORMATS:
        raise ValueError(f"unsupported format: '{chosen}' (valid: {', '.join(FORMATS)})")
    if chosen == "markdown":
        write_markdown(results, path)
    elif chosen == "toon":
        write_toon(results, path, fields, aggregates)
    else:
        write_json(results, path, fields)
