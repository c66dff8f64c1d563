"""A session with the settings that this library assumes, and the folder that its machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution; other settings by name with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset and all runs on one machine, a temporary one that is then set.

    On a cluster the setting must be there: executors can't see each other's own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI: without a scheme it lies in the session's default file system, as for Spark's own readers."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full if not full.startswith("file:/") or full.startswith("file://") else "file://" + full.removeprefix("file:")
