"""Sources: landed pages, URL batches and fetch logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmill.functions import errors as E
from parchmill.functions.urls import is_valid_url, url_parse_problem
from parchmill.session import cut_lineage


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: ``page_id, url, html`` and whatever else was landed.

    ``path`` is a Parquet file or directory. Any DataFrame with these columns
    will do just as well as a source.
    """
    return spark.read.parquet(path)


def url_batch(spark: SparkSession, source: Sequence[str] | str | DataFrame, order_by: str | None = None) -> DataFrame:
    """An ordered batch ``pos, url``; duplicates stay, order is data.

    ``source`` is a text file of URLs, a DataFrame with ``url`` and an order
    column, or a short Python sequence.
    """
    if isinstance(source, DataFrame):
        return source.select(F.col(order_by or "pos").cast("bigint").alias("pos"), "url")
    if isinstance(source, str):
        # Files are read in any order and in pieces, so the order is taken from their names and offsets.
        file, piece = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        read = spark.read.text(source).select("value", file.alias("file"), piece.alias("piece"), F.monotonically_increasing_id().alias("line"))
        lines = cut_lineage(read.filter(F.trim("value") != ""))
        return _numbered(lines, ["file", "piece"], "line").select("pos", F.trim("value").alias("url"))
    return spark.createDataFrame(list(enumerate(source)), "pos bigint, url string")


def _numbered(rows: DataFrame, parts: list[str], order: str) -> DataFrame:
    """Add ``pos``, counted from 0 over ``parts`` and then ``order``; only the parts' sizes meet in one place."""
    sizes = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*parts, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(order)) - 1
    return rows.withColumn("inside", inside).join(starts, parts).withColumn("pos", F.col("start") + F.col("inside"))


def fetch_error(url: Column, status: Column, status_line: Column) -> Column:
    """Error of one fetch; NULL for any 2xx status."""
    detail = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), status_line)
    return F.when(~status.between(200, 299), E.error_struct(E.FETCH, url, detail)).cast(E.ERROR_TYPE)


def fetch_outcome(log: DataFrame) -> DataFrame:
    """A fetch log (``url, status, status_line, ...``) with ``ok`` and ``error``."""
    error = fetch_error(F.col("url"), F.col("status"), F.col("status_line"))
    return log.withColumn("error", error).withColumn("ok", F.col("error").isNull())


def final_url_error(url: Column, final_url: Column) -> Column:
    """Extraction error of a page whose address cannot be parsed."""
    problem = url_parse_problem(final_url)
    detail = F.concat(F.lit("parsing URL: "), problem)
    return F.when(problem.isNotNull(), E.error_struct(E.EXTRACTION, url, detail)).cast(E.ERROR_TYPE)


def split_valid(urls: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with an ``invalid_url`` error.

    ``strict`` raises for the first invalid URL of the batch instead.
    """
    valid = is_valid_url(F.col("url"))
    invalid = urls.filter(~valid).withColumn("error", E.error_struct(E.INVALID_URL, F.col("url"), F.col("url")))
    if strict:
        first = invalid.agg(F.min_by("error", "pos").alias("error")).first()
        if first["error"] is not None:
            raise ValueError(first["error"]["message"])
    return urls.filter(valid), invalid
