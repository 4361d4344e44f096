"""Change feeds: an append-only table of versioned mutations, written with each write."""

from __future__ import annotations

import time
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omniframe.plans.catalog import Table
from omniframe.plans.planner import constant
from omniframe.plans.values import quote
from omniframe.sources import storage

if TYPE_CHECKING:
    from omniframe.plans.runner import Runner

SCHEMA = "version long, at double, op string, id string, before string, after string"


def pairs(r: Runner, t: Table, before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """(id, before, after) as JSON, one row a changed record."""
    def side(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            return r.spark.createDataFrame([], f"id string, {name} string")
        return df.select(F.col(quote(t.key)).cast("string").alias("id"), F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns])).alias(name))

    return side(before, "before").join(side(after, "after"), "id", "full_outer")


def record(r: Runner, t: Table, before: DataFrame | None, after: DataFrame | None, op: str) -> None:
    version = t.info["version"] = t.info.get("version", 0) + 1
    rows = pairs(r, t, before, after).select(F.lit(version).cast("long").alias("version"), F.lit(time.time()).alias("at"), F.lit(op).alias("op"), "id", "before", "after")
    path = t.info.setdefault("feed", f"{storage.base(r.engine)}/{t.name}/_feed")
    if not t.info.get("original"):
        kept = rows.withColumn("before", F.lit(None).cast("string"))
    else:
        kept = rows
    if t.info.get("changefeed"):
        kept.write.mode("append").parquet(path)
    for live in t.info.get("live", {}).values():
        live["rows"] = storage.once(r.engine, live["rows"].unionByName(live["see"](rows)) if live["rows"] is not None else live["see"](rows))


def feed(r: Runner, t: Table) -> DataFrame:
    path = t.info.get("feed")
    return r.spark.read.schema(SCHEMA).parquet(path) if path else r.spark.createDataFrame([], SCHEMA)


def show(r: Runner, c: dict[str, Any]) -> DataFrame:
    """SHOW CHANGES: mutations since a version or time, oldest first; 100 unless a limit up to 1000 is given."""
    t = r.catalog.table(c["table"])
    df = feed(r, t)
    if c["since"] is not None:
        since = constant(c["since"], r.catalog, r.params)
        df = df.filter(F.col("version") >= since) if isinstance(since, int) else df.filter(F.col("at") >= since.timestamp())
    limit = min(int(constant(c["limit"], r.catalog, r.params)), 1000) if c["limit"] is not None else 100
    return df.orderBy("version", "id").limit(limit)


def compact(r: Runner, t: Table, keep_seconds: float) -> None:
    """Retention: mutations older than this go."""
    path = t.info.get("feed")
    if path:
        kept = feed(r, t).filter(F.col("at") >= time.time() - keep_seconds)
        t.info["feed"] = f"{path}-{int(time.time() * 1000)}"
        kept.write.parquet(t.info["feed"])
