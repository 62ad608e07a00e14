"""Written intermediate tables and small file-system questions."""

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_stored: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: spark.checkpoint.dir.

    Only a local session that lacks the setting gets a temporary folder instead.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/bondmarts-{app}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="bondmarts-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def store(df: DataFrame) -> DataFrame:
    """Write df once and return the written table.

    Cuts the lineage: readers share one computation, and a lost executor costs only its own tasks. The files stay until
    `release`, or the end of the `temporary` block they were written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scanned(df: DataFrame) -> DataFrame:
    """df itself if it comes straight from files, else a written copy: for tables that are read more than once."""
    try:
        df.select("_metadata.file_path")
        return df
    except AnalysisException:
        return store(df)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that `store` wrote in this application, but for the first `keep`. Results that read them must be done."""
    paths = _stored.get(spark.sparkContext.applicationId, [])
    while len(paths) > keep:
        delete(spark, paths.pop())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what `store` wrote in it; write or collect results within."""
    before = len(_stored.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    path, fs = _path(spark, path)
    return fs.exists(path)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists; of several writers at once exactly one succeeds. True for that one.

    The file system creates the file or refuses; on an object store that needs conditional writes, as newer connectors have.
    """
    target, fs = _path(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            handle = os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(text)
        return True
    try:
        stream = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    path, fs = _path(spark, path)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    path, fs = _path(spark, path)
    fs.delete(path, True)


def publish(spark: SparkSession, draft: str, path: str) -> None:
    """Move a written folder to its final place, which must not hold a finished one."""
    source, fs = _path(spark, draft)
    target, _ = _path(spark, path)
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"could not move {draft} to {path}")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted child names of a folder; empty when it does not exist."""
    path, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
