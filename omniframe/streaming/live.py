"""Live queries: notifications of a table's changes, and the same over a stream of rows."""

import uuid
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from omniframe.functions.documents import diff_text
from omniframe.plans import ast as A
from omniframe.plans.catalog import Catalog
from omniframe.plans.compiler import QueryError, condition
from omniframe.plans.planner import Planner

if TYPE_CHECKING:
    from omniframe.plans.runner import Runner


def patches(before: pd.Series, after: pd.Series) -> pd.Series:
    """The JSON patch from one document to the other; a missing one counts as empty."""
    return pd.Series([diff_text(a or "{}", b or "{}") for a, b in zip(before, after)])


def start(r: "Runner", c: dict[str, Any]) -> str:
    """Register a live query; its notifications gather until they are taken."""
    s: A.Select = c["select"]
    name = s.sources[0].parts[0].value
    t = r.catalog.table(name)
    kind = t.df().schema

    def see(rows: DataFrame) -> DataFrame:
        json = F.coalesce("after", "before")
        body = rows.withColumn("_row", F.from_json(json, kind)).select("op", "id", "before", "after", "_row.*") if "id" not in kind.names else rows.select("op", F.col("id").alias("_id"), "before", "after", F.from_json(json, kind).alias("_row")).select("op", "_id", "before", "after", "_row.*")
        p = Planner(r.catalog, r.params)
        p.df, p.scope.table = body, name
        p.where(s.where)
        key = F.col("_id") if "_id" in body.columns else F.col("id")
        if c["diff"]:
            patch = F.pandas_udf(patches, "string")
            return p.df.select("op", key.alias("id"), patch("before", "after").alias("result"))
        return p.df.select("op", key.alias("id"), F.coalesce("after", "before").alias("result"))

    live_id = str(uuid.uuid4())
    t.info.setdefault("live", {})[live_id] = {"see": see, "rows": None}
    return live_id


def stop(r: "Runner", live_id: str) -> None:
    for t in r.catalog.tables.values():
        if t.info.get("live", {}).pop(live_id, None) is not None:
            return
    raise QueryError(f"no live query {live_id}")


def taken(catalog: Catalog, live_id: str) -> DataFrame | None:
    """The notifications (op, id, result) so far, which are then forgotten."""
    for t in catalog.tables.values():
        if live_id in t.info.get("live", {}):
            live = t.info["live"][live_id]
            rows, live["rows"] = live["rows"], None
            return rows
    raise QueryError(f"no live query {live_id}")


def stream(catalog: Catalog, rows: DataFrame, text: str) -> DataFrame:
    """A live SELECT over a streaming frame: WHERE and the projection as a streaming plan."""
    from omniframe.plans.parser import Parser

    p0 = Parser(text)
    p0.want_word("SELECT")
    s = p0.select()
    p = Planner(catalog)
    p.df = rows
    if s.where is not None:
        p.df = p.df.filter(condition(s.where, p.scope))
    return p.projected(A.Select(columns=s.columns), {})


def notify(rows: DataFrame, checkpoint: str, sink: Any) -> StreamingQuery:
    """Push each micro-batch to ``sink(batch, number)``, once for all that is there now."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
