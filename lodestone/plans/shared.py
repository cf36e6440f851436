"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: what the session names in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder; it is removed when the driver ends."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return uri


def write_files(spark: SparkSession, uri: str, contents: dict[str, str]) -> None:
    """Write a few small files below uri, by whatever store it is in."""
    for name, text in contents.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{uri}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()


def plain_path(uri: str) -> str:
    """A file: URI as a path of this machine; any other as it is."""
    return "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri
