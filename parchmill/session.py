"""Session settings every job here relies on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "parchmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster-provided values win.

    Nothing here sizes the cluster: executor memory, shuffle partitions and the
    checkpoint folder come from the submit command.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: times are rendered in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share, for tables between steps.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder serves a local master; on a cluster it is an error, as each
    executor would write to its own disk.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or _local_folder
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="parchmill-shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        _local_folder = named
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write what is costly to make and read more than once to the shared folder, and go on from the copy."""
    path = f"{shared_folder(df.sparkSession)}/parchmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a small table that several later steps read, and go on from the copy."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
