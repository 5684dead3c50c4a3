"""Reading and writing the page store."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.functions.urls import normalize_url, url_key
from parchmill.operators.convert import as_of_column
from parchmill.operators.store import AsOf, clear_report, latest_entries, store_totals
from parchmill.schemas import STORE, STORE_JSON
from parchmill.sources import entry_files


def read_store(
    spark: SparkSession,
    path: str,
    layout: str = "parquet",
    without_batch: int | str | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Entries of a store; a store that does not exist yet is empty.

    ``layout='json'`` reads a directory with one JSON file per entry, whose
    file time is the entry's age; there a corrupt file is one entry missed. The
    key is the file's name, or the name of its folder as ``write_store_files``
    makes them. Files of the machines' own file system are listed and read by
    tasks when rows are asked for; of any other, the driver holds the list. A
    Parquet file holds many, so an unreadable one fails the job unless
    ``skip_corrupt`` says otherwise. ``without_batch`` leaves out what one batch
    wrote: a batch that may run again must not find its own entries.
    """
    try:
        if layout == "json":
            return _read_json(spark, path)
        by_batch = T.StructType([*STORE.fields, T.StructField("batch", T.StringType())])
        reader = spark.read.schema(by_batch).option("ignoreCorruptFiles", str(skip_corrupt).lower())
        entries = reader.option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)
    if without_batch is not None:
        entries = entries.filter(~F.col("batch").eqNullSafe(str(without_batch)))
    return entries.drop("batch")


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*STORE_JSON.fields, T.StructField("_corrupt", T.StringType())])
    lenient = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    root = entry_files.local_folder(spark, path)
    if root is not None and os.path.isdir(root):
        # Spark's reader takes a list of entries for as many, so this does too. A generator parses a text once.
        several = F.when(F.col("text").rlike(r"^\s*\["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
        parsed = F.transform(several, lambda one: F.from_json(one, schema, lenient))
        entries = entry_files.texts(spark, root).select("url_key", "stored_at", F.inline(parsed))
    else:
        entries = spark.read.schema(schema).options(**lenient, multiLine="true", recursiveFileLookup="true").json(path)
        folder = F.regexp_extract("_metadata.file_path", "/url_key=([^/]+)/[^/]+$", 1)
        key = F.when(folder != "", folder).otherwise(F.regexp_replace("_metadata.file_name", r"\.json$", ""))
        entries = entries.select("*", key.alias("url_key"), F.col("_metadata.file_modification_time").alias("stored_at"))
    meta = F.struct(
        F.col("metadata.Title").alias("title"),
        F.col("metadata.Author").alias("author"),
        F.col("metadata.PublishDate").alias("publish_date"),
        F.col("metadata.Description").alias("description"),
    )
    return entries.select(
        "_corrupt", "url_key", "url", F.col("fetchedAt").alias("fetched_at"), "markdown", meta.alias("meta"), "stored_at"
    ).filter(F.col("_corrupt").isNull() & F.col("markdown").isNotNull()).drop("_corrupt")


def store_rows(documents: DataFrame, as_of: AsOf) -> DataFrame:
    """Documents (``url, markdown, meta``) as store entries; unparsable URLs have no key and drop out."""
    now = as_of_column(as_of)
    keyed = documents.select(
        url_key(F.col("url")).alias("url_key"),
        normalize_url(F.col("url")).alias("url"),
        now.alias("fetched_at"),
        "markdown",
        "meta",
        now.alias("stored_at"),
    )
    return keyed.filter(F.col("url_key").isNotNull())


def write_store(entries: DataFrame, path: str, batch_id: int | str | None = None) -> None:
    """Append entries; with ``batch_id`` a repeated write replaces itself.

    Only the new rows are written, however large the store is. Readers take
    the newest entry of a key; ``compact_store`` folds old ones away.
    """
    batch = uuid.uuid4().hex if batch_id is None else batch_id
    target = f"{path.rstrip('/')}/batch={batch}"
    entries.select(*STORE.names).write.mode("overwrite").parquet(target)


def write_store_files(entries: DataFrame, path: str) -> None:
    """Write entries as one JSON file each, ``prefix=<two digits of the key>/url_key=<key>/``.

    The newest entry of a key replaces the file that stands; other keys keep
    theirs, and a repeated write changes nothing but file times. Rows without
    key are left out. Tasks write their keys one after another, one file open at a
    time. In the machines' own file system they put each in its place themselves:
    a write that fails leaves whole entries, and repeating it completes them.
    """
    known = lambda name: F.coalesce(F.col(f"meta.{name}"), F.lit(""))
    rows = latest_entries(entries.filter(F.col("url_key").isNotNull())).select(
        "url",
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("fetchedAt"),
        "markdown",
        F.struct(
            known("title").alias("Title"),
            known("author").alias("Author"),
            known("publish_date").alias("PublishDate"),
            known("description").alias("Description"),
        ).alias("metadata"),
        F.substring("url_key", 1, 2).alias("prefix"),
        "url_key",
    )
    root = entry_files.local_folder(entries.sparkSession, path)
    if root is not None:
        text = F.to_json(F.struct("url", "fetchedAt", "markdown", "metadata"))
        return entry_files.put(rows.select("url_key", text.alias("text")), root)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("prefix", "url_key").json(path)


def append_texts(texts: DataFrame, path: str) -> None:
    """Write a file of each of ``texts`` (url_key, text) as it is, beside what the key has in a store of one file per entry."""
    root = entry_files.local_folder(texts.sparkSession, path)
    if root is not None:
        return entry_files.put(texts, root, append_as="txt")
    rows = texts.select("text", F.substring("url_key", 1, 2).alias("prefix"), "url_key")
    rows.write.mode("append").partitionBy("prefix", "url_key").text(path)


def compact_store(store: DataFrame, target: str) -> None:
    """Write the newest entry of each key to a new store, as a batch like any other."""
    write_store(latest_entries(store), target, f"compact-{uuid.uuid4().hex}")


def _listing(spark: SparkSession, path: str) -> tuple[object, list]:
    """The file system of a folder, and what stands in it; hidden files do not count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(folder) if system.exists(folder) else []
    return system, [f for f in found if not f.getPath().getName().startswith(("_", "."))]


def _files(system: object, found: list) -> tuple[int, int]:
    """How many files stand under ``found``, and their bytes: the file system adds up each folder, which hands over no list."""
    sums = [(1, f.getLen()) if f.isFile() else _folder_sums(system, f) for f in found]
    return sum(n for n, _ in sums), sum(b for _, b in sums)


def _folder_sums(system: object, folder: object) -> tuple[int, int]:
    summary = system.getContentSummary(folder.getPath())
    return summary.getFileCount(), summary.getLength()


def store_clear(spark: SparkSession, path: str, layout: str = "parquet") -> DataFrame:
    """Remove all entries; returns a one-row report.

    Deletes nothing but batches, or JSON files and their prefix folders of the
    other layout, whether or not they can be read; a folder that holds anything
    else is no store and an error. Batches and prefix folders go whole, a call
    each; entry files of the machines' own file system are counted and removed
    by tasks. ``reason`` tells why there was nothing to remove.
    """
    root = entry_files.local_folder(spark, path) if layout == "json" else None
    if root is not None and os.path.isdir(root):
        _refuse(path, layout, entry_files.strangers(spark, root))
        removed = entry_files.sums(spark, root)[0]
        entry_files.remove(spark, root)
        return spark.range(1).select(*clear_report(F.lit(removed).cast("bigint"), path))
    system, found = _listing(spark, path)
    if layout == "json":
        other = [f for f in found if not f.getPath().getName().endswith(".json") and not _is_prefix(f)]
    else:
        other = [f for f in found if not f.getPath().getName().startswith("batch=")]
    _refuse(path, layout, other[0].getPath().getName() if other else None)
    removed = _files(system, found)[0] if layout == "json" else read_store(spark, path).count() if found else 0
    exists = system.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    for file in found:
        system.delete(file.getPath(), True)
    return spark.range(1).select(*clear_report(F.lit(removed).cast("bigint"), path, exists))


def _refuse(path: str, layout: str, other: str | None) -> None:
    if other is not None:
        raise ValueError(f"{path} is no {layout} store: it holds {other}")


def _is_prefix(file: object) -> bool:
    return file.isDirectory() and file.getPath().getName().startswith("prefix=")


def store_file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of a one-file-per-entry store, without reading a file: every one counts, readable or not, empty ones too.

    In the machines' own file system tasks add up a prefix folder each. In any
    other, prefix folders, at most a few hundred, are added up by the file system,
    and files of a flat store are listed at once. What is hidden does not count.
    """
    root = entry_files.local_folder(spark, path)
    if root is not None and os.path.isdir(root):
        entries, size = entry_files.sums(spark, root)
    else:
        entries, size = _files(*_listing(spark, path))
    return store_totals(spark.createDataFrame([(entries, size)], "entries bigint, bytes bigint"), path)
