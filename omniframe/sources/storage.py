"""Where tables' versions live, and readers and writers of files."""

from __future__ import annotations

import tempfile
import uuid
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from omniframe.engine import Engine


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="omniframe-tables-")
    return found.rstrip("/")


def base(engine: Engine) -> str:
    """The engine's warehouse; else a folder below the shared one."""
    if not engine.warehouse:
        engine.warehouse = f"{shared(engine.spark)}/tables-{uuid.uuid4().hex}"
    return engine.warehouse


def store(engine: Engine, name: str, df: DataFrame) -> DataFrame:
    """Write one version of a table and return its reading."""
    path = f"{base(engine)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return engine.spark.read.schema(df.schema).parquet(path)


def once(engine: Engine, df: DataFrame) -> DataFrame:
    """Rows worked out once, so that fresh ids and times stay what they are."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    clean = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    return store(engine, "_rows", clean)


READERS = ("parquet", "orc", "json", "csv", "text", "binaryFile", "avro", "jdbc", "xml")


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options: Any) -> DataFrame:
    """Any of Spark's file formats; a schema saves the inference pass over JSON and CSV."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, kind: str, path: str, partition_by: list[str] | None = None, mode: str = "error", **options: Any) -> None:
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


class Bucket:
    """Files of an object store, by Hadoop's file system: put, get, head, list, copy, rename, delete, exists."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _at(self, key: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key.lstrip('/')}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: str, data: bytes | str, if_absent: bool = False) -> bool:
        p, fs = self._at(key)
        if if_absent and fs.exists(p):
            return False
        out = fs.create(p, True)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
        return True

    def get(self, key: str) -> bytes | None:
        p, fs = self._at(key)
        if not fs.exists(p):
            return None
        rows = self.spark.read.format("binaryFile").load(p.toString()).select("content").collect()
        return bytes(rows[0][0]) if rows else None

    def head(self, key: str) -> dict[str, Any] | None:
        p, fs = self._at(key)
        if not fs.exists(p):
            return None
        s = fs.getFileStatus(p)
        return {"key": key, "size": s.getLen(), "updated": s.getModificationTime()}

    def exists(self, key: str) -> bool:
        p, fs = self._at(key)
        return fs.exists(p)

    def delete(self, key: str) -> None:
        p, fs = self._at(key)
        fs.delete(p, False)

    def copy(self, key: str, to: str, if_absent: bool = False) -> bool:
        data = self.get(key)
        return data is not None and self.put(to, data, if_absent)

    def rename(self, key: str, to: str, if_absent: bool = False) -> bool:
        p, fs = self._at(key)
        q, _ = self._at(to)
        if fs.exists(q):
            if if_absent:
                return False
            fs.delete(q, False)
        return fs.rename(p, q)

    def list(self, prefix: str = "", limit: int | None = None) -> list[dict[str, Any]]:
        p, fs = self._at("")
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            key = s.getPath().toString().split(self.root.split("://")[-1], 1)[-1].lstrip("/")
            if key.startswith(prefix) and not key.split("/")[-1].startswith("."):
                out.append({"key": key, "size": s.getLen()})
        return sorted(out, key=lambda x: x["key"])[:limit]
