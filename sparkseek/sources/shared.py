"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a session on one machine gets a folder of its own; on a cluster that is an error, as no local folder
    is shared there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir
    if not known().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sparkseek-')}")
    return known().get()


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have been stopped
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_folders: set[str] = set()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder of the shared one, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(delete, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
