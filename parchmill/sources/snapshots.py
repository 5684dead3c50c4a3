"""The page store as snapshots of key-prefix buckets.

A write puts its entries into a folder of its own, a sub-folder per bucket of
the key, sorted by key. It counts once a snapshot lists it: a small file named
by a version number, which names all folders that make up the store. Snapshots
are never changed, so a reader keeps the one it opened whatever is written or
compacted meanwhile. Making a snapshot of a number that exists fails, and the
writer then adds its folder to the newer one; no write is lost.

    path/data/write=<label>-<unique>/bucket=<n>/part-...parquet
    path/snapshots/<version>.json       {"folders": [{"name": ..., "label": ...}]}
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.operators.store import AsOf, expired_entries, latest_entries
from parchmill.schemas import STORE

# 16^2 buckets by the first two digits of a key, which are evenly spread.
PREFIX_DIGITS = 2
BUCKETED = T.StructType([*STORE.fields, T.StructField("bucket", T.IntegerType())])
_IN_FOLDERS = T.StructType([*BUCKETED.fields, T.StructField("write", T.StringType())])


def bucket_of(key: Column) -> Column:
    return F.conv(F.substring(key, 1, PREFIX_DIGITS), 16, 10).cast("int")


class _Files:
    """The store's folder in whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.system = self.at("").getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.system.getUri(), conf)

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        found = self.system.listStatus(place) if self.system.exists(place) else []
        return sorted(f.getPath().getName() for f in found)

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put a whole file in place unless there is one already."""
        draft = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.system.create(self.at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.hadoop, "Options$Rename")
        no_overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        no_overwrite[0] = rename.NONE
        try:
            self.context.rename(self.at(draft), self.at(name), no_overwrite)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            self.system.delete(self.at(draft), False)
            return False


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots, oldest first."""
    return [int(n[:-5]) for n in _Files(spark, path).names("snapshots") if n.endswith(".json")]


def _folders(files: _Files, version: int) -> list[dict]:
    return json.loads(files.read(f"snapshots/{version:012d}.json"))["folders"] if version else []


def _commit(spark: SparkSession, path: str, change: Callable[[list[dict]], list[dict]]) -> int:
    """Make the next snapshot from the newest one; starts over if another writer was first."""
    files = _Files(spark, path)
    while True:
        newest = max(versions(spark, path), default=0)
        text = json.dumps({"folders": change(_folders(files, newest))})
        if files.create(f"snapshots/{newest + 1:012d}.json", text):
            return newest + 1


def _write_folder(entries: DataFrame, path: str, label: str) -> dict:
    name = f"write={label}-{uuid.uuid4().hex}"
    bucketed = entries.select(*STORE.names, bucket_of(F.col("url_key")).alias("bucket"))
    # Hashed keys fill buckets evenly, so a bucket needs no salting; many buckets share a task.
    dealt = bucketed.repartition("bucket").sortWithinPartitions("bucket", "url_key")
    dealt.write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/data/{name}")
    return {"name": name, "label": label}


def write_entries(entries: DataFrame, path: str, label: str | int | None = None) -> int:
    """Add entries (``schemas.STORE``) as a new snapshot; returns its version.

    A write of a ``label`` that the store has replaces the earlier one, so a
    batch that runs again changes nothing.
    """
    label = uuid.uuid4().hex if label is None else str(label)
    folder = _write_folder(entries, path, label)
    return _commit(entries.sparkSession, path, lambda known: [f for f in known if f["label"] != label] + [folder])


def read_snapshot(
    spark: SparkSession, path: str, version: int | None = None, without_label: str | int | None = None
) -> DataFrame:
    """Entries of one snapshot, by default the newest, with their ``bucket``; none of a store that does not exist.

    Readers of a bucketed store read the buckets they ask for (a partition
    filter on ``bucket``). ``without_label`` leaves out what one write added.
    """
    files = _Files(spark, path)
    if version is None:
        version = max(versions(spark, path), default=0)
    names = [f["name"] for f in _folders(files, version) if f["label"] != str(without_label)]
    places = [f"{files.path}/data/{n}" for n in names]
    if not places:
        return spark.createDataFrame([], BUCKETED)
    return spark.read.schema(_IN_FOLDERS).option("basePath", f"{files.path}/data").parquet(*places).drop("write")


def compact_snapshot(spark: SparkSession, path: str, as_of: AsOf | None = None, ttl=None) -> int:
    """Fold the newest entry of each key into one folder; returns the new version.

    With ``as_of``, entries older than ``ttl`` go. Folders that were added
    while this ran stay as they are, and so do older snapshots.
    """
    files = _Files(spark, path)
    start = max(versions(spark, path), default=0)
    folded = {f["name"] for f in _folders(files, start)}
    entries = latest_entries(read_snapshot(spark, path, start).drop("bucket"))
    if as_of is not None:
        entries = entries.exceptAll(expired_entries(entries, as_of, ttl))
    folder = _write_folder(entries, path, "compacted")
    return _commit(spark, path, lambda known: [folder] + [f for f in known if f["name"] not in folded])


def drop_old_snapshots(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the newest ``keep`` snapshots and the folders that only those listed; returns their names.

    For when no reader of an older one is left. Folders that no snapshot ever
    listed are left alone: a writer may be about to commit them.
    """
    files = _Files(spark, path)
    known = versions(spark, path)
    old, kept = known[: -max(1, keep)], known[-max(1, keep) :]
    needed = {f["name"] for v in kept for f in _folders(files, v)}
    gone = sorted({f["name"] for v in old for f in _folders(files, v)} - needed)
    for version in old:
        files.system.delete(files.at(f"snapshots/{version:012d}.json"), False)
    for name in gone:
        files.system.delete(files.at(f"data/{name}"), True)
    return gone
