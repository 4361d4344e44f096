"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which the
driver and every executor can reach, so a lost executor costs a re-read and no
recomputation of earlier passes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on one machine (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="omniframe-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/omniframe/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the reading of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._omniframe_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a saved table that no later plan reads."""
    path = getattr(df, "_omniframe_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone already
            return
