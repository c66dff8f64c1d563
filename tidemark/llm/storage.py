"""Durable intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; losing an executor never loses such a
table. Only where that setting is absent and all runs on one machine (tests) a local folder is used instead.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder

_paths: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``drop`` or program exit removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables made by ``materialize`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            _delete(df.sparkSession, path)
            _paths[:] = [x for x in _paths if x[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in _paths:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder is scratch space
            break
