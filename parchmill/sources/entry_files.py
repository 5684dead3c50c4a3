"""Files of one entry each, in a folder that tasks reach under the paths of their machine.

Tasks list, read, write, count and remove them, so neither the driver's memory
nor its time grows with their number. A store in another file system goes through
Spark's own readers and writers (``sources.store``). Rows are keyed as these key
them: ``prefix=<two digits of the key>/url_key=<key>/``, names escaped alike.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get these functions with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a task hands on at once: files, and bytes of them.
FILES_AT_ONCE = 1000
BYTES_AT_ONCE = 4 << 20

# What Spark calls the folder of a missing value, and escapes in names of folders.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_PLAIN = re.compile(r"[A-Za-z0-9\-_.!~*'():@&=+$,;]+")
_GLOB = re.compile(r"[{}\[\]*?\\]")

# Names in a store's own folder that are not hidden.
PLAIN = "substr(name, 1, 1) not in (X'5F', X'2E')"

ENTRY = "entry.json"
DRAFT = ".draft-"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's path on the machines themselves; None for a pattern, and in any file system but theirs."""
    if _GLOB.search(path):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _named(key: str, value: str | None) -> str:
    return f"{key}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE)


def _write(folder: str, name: str, text: bytes, alone: bool) -> None:
    """Put a file in place by a rename; ``alone``: then what else stood in the folder goes."""
    try:
        os.mkdir(folder)
        stood = False
    except FileExistsError:
        stood = True
    except FileNotFoundError:
        os.makedirs(folder, exist_ok=True)
        stood = True
    draft = f"{folder}/{DRAFT}{uuid.uuid4().hex}"
    with open(draft, "wb") as file:
        file.write(text)
        file.write(b"\n")
    os.replace(draft, f"{folder}/{name}")
    if alone and stood:
        with os.scandir(folder) as found:
            others = [f.path for f in found if f.name != name and not f.name.startswith(DRAFT)]
        for other in others:
            _remove(other)


def put(rows: DataFrame, root: str, append_as: str | None = None) -> None:
    """Write a file of each of ``rows`` (url_key, text); it is whole as soon as it is seen.

    It replaces what its key has, so keys must not repeat; with ``append_as``, a
    file name's ending, it stands beside that.
    """
    call = uuid.uuid4().hex

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/{_named('prefix', key and key[:2])}/{_named('url_key', key)}"
                name = ENTRY if append_as is None else f"part-{task:05}-{call}-{n}.{append_as}"
                _write(folder, name, text or b"", append_as is None)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    os.makedirs(root, exist_ok=True)
    written = rows.select("url_key", F.col("text").cast("binary").alias("text")).mapInArrow(write, "files long")
    written.write.format("noop").mode("overwrite").save()
    open(f"{root}/_SUCCESS", "wb").close()


def _shown(name: bytes) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    if name.startswith((b"_common_metadata", b"_metadata")):
        return True
    return not (name.startswith(b".") or (name.startswith(b"_") and b"=" not in name) or name.endswith(b"._COPYING_"))


def _files(path: bytes) -> Iterator[bytes]:
    if not os.path.isdir(path):
        yield path
        return
    with os.scandir(path) as found:
        for file in found:
            if _shown(file.name):
                yield from _files(file.path) if file.is_dir() else [file.path]


def _remove(path: str | bytes) -> None:
    """Remove a file or folder; what another attempt at it has removed is no error."""
    with contextlib.suppress(FileNotFoundError):
        if os.path.islink(path) or not os.path.isdir(path):
            os.unlink(path)
            return
        with os.scandir(path) as found:
            inside = [f.path for f in found]
        for file in inside:
            _remove(file)
        os.rmdir(path)


def names(spark: SparkSession, root: str) -> DataFrame:
    """What stands in the folder itself: name (bytes), folder (whether it is one), and shown (whether readers see it)."""

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        some = []
        kinds = {"name": pa.binary(), "folder": pa.bool_(), "shown": pa.bool_()}
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([s[i] for s in some], k) for i, k in enumerate(kinds.values())], names=list(kinds))
        for _ in batches:
            with os.scandir(os.fsencode(root)) as found:
                for file in found:
                    some.append((file.name, file.is_dir(), _shown(file.name)))
                    if len(some) >= FILES_AT_ONCE:
                        yield pack()
                        some.clear()
        yield pack()

    return spark.range(0, 1, 1, 1).mapInArrow(listed, "name binary, folder boolean, shown boolean")


def _dealt(found: DataFrame) -> DataFrame:
    """Names, each in the task that sees to all that it holds."""
    return found.select("name").repartition(max(64, 4 * found.sparkSession.sparkContext.defaultParallelism), "name")


def _text(data: bytes) -> bytes | None:
    """A JSON file in UTF-8, whatever its encoding, as Spark's reader makes it out; None if it is no text."""
    try:
        return data.decode(json.detect_encoding(data)).encode()
    except UnicodeError:
        return None


def _quoted(name: str) -> str:
    """As Spark gives names of files and folders: with escapes for what a URI's path cannot hold."""
    if _PLAIN.fullmatch(name):
        return name
    held = lambda c: _PLAIN.match(c) or (c > "\x9f" and unicodedata.category(c)[0] != "Z")
    return "".join(c if held(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


def _key(path: bytes) -> str:
    folder, name = os.path.split(path)
    folder = os.path.basename(folder)
    keyed = folder.removeprefix(b"url_key=") if folder.startswith(b"url_key=") else b""
    return _quoted((keyed or name.removesuffix(b".json")).decode("utf-8", "replace"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """url_key, stored_at (the file's time) and text of each file under the folder; what is no text is left out."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, times, found, size = [], [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64()), pa.array(found, pa.binary())], names=["url_key", "millis", "text"])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for path in _files(os.path.join(os.fsencode(root), name)):
                    with open(path, "rb") as file:
                        millis, text = os.fstat(file.fileno()).st_mtime_ns // 1_000_000, _text(file.read())
                    if text is None:
                        continue
                    if found and size + len(text) > BYTES_AT_ONCE or len(found) >= FILES_AT_ONCE:
                        yield pack()
                        keys, times, found, size = [], [], [], 0
                    keys.append(_key(path))
                    times.append(millis)
                    found.append(text)
                    size += len(text)
        yield pack()

    read_ = _dealt(names(spark, root).filter("shown")).mapInArrow(read, "url_key string, millis long, text binary")
    return read_.select("url_key", F.timestamp_millis("millis").alias("stored_at"), F.col("text").cast("string").alias("text"))


def sums(spark: SparkSession, root: str) -> tuple[int, int]:
    """How many files stand under the folder, and their bytes; what is hidden does not count."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = size = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for path in _files(os.path.join(os.fsencode(root), name)):
                    n, size = n + 1, size + os.stat(path).st_size
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["n", "size"])

    found = _dealt(names(spark, root).filter(PLAIN)).mapInArrow(add, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    return found[0] or 0, found[1] or 0


def strangers(spark: SparkSession, root: str) -> str | None:
    """A name in the folder of what is neither an entry nor a prefix folder, if there is one; what is hidden does not count."""
    known = "endswith(name, cast('.json' as binary)) or folder and startswith(name, cast('prefix=' as binary))"
    found = names(spark, root).filter(PLAIN).filter(f"not ({known})").select("name").first()
    return found and os.fsdecode(bytes(found[0]))


def remove(spark: SparkSession, root: str) -> None:
    """Remove all that stands in the folder and is not hidden."""

    def clear(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                _remove(os.path.join(os.fsencode(root), name))
                _remove(os.path.join(os.fsencode(root), b"." + name + b".crc"))
        yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

    _dealt(names(spark, root).filter(PLAIN)).mapInArrow(clear, "done boolean").write.format("noop").mode("overwrite").save()
