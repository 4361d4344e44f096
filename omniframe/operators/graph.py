"""Graph traversal over edge tables: hops as equality joins, recursion as a loop of them.

A walk starts from keys and joins edge tables and node tables hop by hop; the
results are gathered to an ordered array per start with one aggregation. Recursive
walks keep only the frontier and, for collect and shortest, the visited pairs.
Each level's frontier is cut from its lineage by a reliable checkpoint when
one is configured. Levels are joined by sorting and merging: a broadcast a level
would send the hops through the driver as often as there are levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omniframe.plans.catalog import Table

MOST_LEVELS = 256


class RecursionLimit(ValueError):
    """A walk that would go on for too many levels."""


@dataclass
class Walk:
    """rows: _src (start), _ord (order so far, an array of strings), _at (where the walk stands)."""

    rows: DataFrame
    table: str
    on_edge: bool = False
    edge_cols: tuple[str, ...] = ()


def edge_ends(t: Table, direction: str) -> list[tuple[str, str]]:
    """(column that is met, column that is reached) of an edge table."""
    e = t.edge
    ahead, back = (e.from_col, e.to_col), (e.to_col, e.from_col)
    return {"out": [ahead], "in": [back], "both": [ahead, back]}[direction]


def edge_rows(t: Table, direction: str, df: DataFrame) -> DataFrame:
    """The edge table with _met and _reached; both directions are a union."""
    order = t.sort or [t.edge.from_col, t.edge.to_col]
    parts = [df.withColumns({"_met": F.col(a), "_reached": F.col(b), "_eo": F.concat_ws("\x01", *[pad(F.col(c), df.schema[c].dataType) for c in order])}) for a, b in edge_ends(t, direction)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pad(col, kind) -> F.Column:  # noqa: ANN001
    """A column as text that sorts like the column."""
    if kind.typeName() in ("integer", "long", "short", "byte"):
        return F.lpad((col.cast("decimal(20,0)") + F.lit(1 << 62)).cast("string"), 20, "0")
    if kind.typeName() in ("double", "float", "decimal"):
        return F.lpad((F.round(col.cast("double") * 10000).cast("decimal(38,0)") + F.lit("1" + "0" * 24).cast("decimal(38,0)")).cast("string"), 26, "0")
    return F.coalesce(col.cast("string"), F.lit(""))


def pairs(hops: list[tuple[str, Table, DataFrame]]) -> DataFrame:
    """(_from, _to) of a chain of (direction, edge table, its rows) hops with node tables between."""
    out = None
    for direction, t, rows in hops:
        e = edge_rows(t, direction, rows).select(F.col("_met").alias("_from"), F.col("_reached").alias("_to"))
        out = e if out is None else out.join(e.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end")), F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to"))
    return out


def _cut(df: DataFrame) -> DataFrame:
    """One level, cut from its lineage; written to the cluster's checkpoint folder where there is one."""
    spark = df.sparkSession
    if spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return df.checkpoint()
    return df.cache()


def recurse(starts: DataFrame, hop: DataFrame, how: str = "default", least: int = 1, most: int | None = None, target: object = None, inclusive: bool = False) -> DataFrame:
    """Repeated hops from every start.

    starts: one column, the start keys. hop: (_from, _to). Returns
    - default: (start, node): where the walk ends by following the hop up to ``most`` times, stopping at a dead end or a cycle to itself
      (with several ways on, all of them);
    - collect: (start, node, depth): every node that is reached, once, at its smallest depth;
    - path: (start, path): every path as an array of nodes, ended by ``most`` or a dead end; nodes do not repeat in a path;
    - shortest: (start, path): a shortest path to ``target`` (the smallest of equals), for starts that reach it.

    A walk without a bound that goes on after MOST_LEVELS hops is an error, as is a bound above it.
    """
    if most is not None and most > MOST_LEVELS:
        raise RecursionLimit(f"a walk of {most} levels is beyond the limit of {MOST_LEVELS}")
    limit = most or MOST_LEVELS

    def beyond(level: int) -> bool:
        if most is None and level == limit:
            raise RecursionLimit(f"the walk goes on after {MOST_LEVELS} levels")
        return False

    s = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    h = hop.select("_from", "_to").filter("_from IS NOT NULL AND _to IS NOT NULL").distinct().hint("merge")
    if how == "collect":
        seen = s.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
        front = seen
        for level in range(1, limit + 1):
            new = front.join(h, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
            new = _cut(new.join(seen.hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
            if new.isEmpty():
                break
            beyond(level)
            seen, front = seen.unionByName(new), new
        return seen.filter(F.col("depth") >= (0 if inclusive else max(least, 1)))
    if how == "shortest":
        return _shortest(s, h, limit, most, target, inclusive)
    if how == "path":
        paths = s.select("start", F.array("start").alias("path"))
        done = None
        for level in range(1, limit + 1):
            grown = paths.join(h, F.element_at("path", -1) == F.col("_from"), "left")
            onward = grown.filter(F.col("_to").isNotNull() & ~F.array_contains("path", F.coalesce("_to", F.element_at("path", -1))))
            new = _cut(onward.select("start", F.array_append("path", F.col("_to")).alias("path")))
            alive = new.select("start", F.slice("path", 1, level).alias("path")).distinct()
            ended = paths.join(alive.hint("merge"), ["start", "path"], "left_anti").filter(F.size("path") > least)
            done = ended if done is None else done.unionByName(ended)
            paths = new
            if new.isEmpty():
                break
            beyond(level)
        if most is not None:
            done = done.unionByName(paths.filter(F.size("path") > least))
        first = 1 if inclusive else 2
        return done.select("start", F.expr(f"slice(path, {first}, size(path))").alias("path")).filter(F.size("path") > 0)
    front = s.select("start", F.col("start").alias("node"))
    ended = None
    for level in range(1, limit + 1):
        grown = front.join(h.filter("_from <> _to").hint("merge"), F.col("node") == F.col("_from"), "left")
        if level > least:
            stop = grown.filter("_to IS NULL").select("start", "node")
            ended = stop if ended is None else ended.unionByName(stop)
        front = _cut(grown.filter("_to IS NOT NULL").select("start", F.col("_to").alias("node")).distinct())
        if front.isEmpty():
            break
        beyond(level)
    return front if ended is None else ended.unionByName(front).distinct()


def _shortest(s: DataFrame, h: DataFrame, limit: int, most: int | None, target: object, inclusive: bool) -> DataFrame:
    """Breadth first: a node is kept once a start, with the smallest of its shortest paths; starts that have arrived stop."""
    front = s.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    seen = front.select("start", "node")
    done = None
    for level in range(1, limit + 1):
        step = front.join(h, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path"))
        new = _cut(step.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen.hint("merge"), ["start", "node"], "left_anti"))
        hit = new.filter(F.col("node") == F.lit(target)).select("start", "path")
        done = hit if done is None else done.unionByName(hit)
        if new.isEmpty():
            break
        if most is None and level == limit:
            raise RecursionLimit(f"the walk goes on after {MOST_LEVELS} levels")
        seen = seen.unionByName(new.select("start", "node"))
        front = new.join(hit.select("start").hint("merge"), "start", "left_anti")
    first = 1 if inclusive else 2
    return done.select("start", F.expr(f"slice(path, {first}, size(path))").alias("path")).filter(F.size("path") > 0)


def tree(starts: DataFrame, hop: DataFrame, depth: int) -> DataFrame:
    """(start, tree): nested (node, children) structures of the walk, put together from the bottom level up."""
    s = starts.select(F.col(starts.columns[0]).alias("node")).distinct()
    hop = hop.hint("merge")
    levels = [s]
    for _ in range(depth):
        nxt = levels[-1].join(hop, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        levels.append(nxt)
    below = levels[-1].select("node", F.struct(F.col("node").alias("id")).alias("t"))
    for level in reversed(levels[:-1]):
        kids = level.join(hop, F.col("node") == F.col("_from")).join(below.select(F.col("node").alias("_to"), "t").hint("merge"), "_to").groupBy("node").agg(F.sort_array(F.collect_list("t")).alias("kids"))
        empty = F.expr("slice(array(t), 1, 0)")
        shape = below.select(F.first("t").alias("t")).select(empty.alias("none"))
        below = level.join(kids.hint("merge"), "node", "left").crossJoin(F.broadcast(shape)).select("node", F.struct(F.col("node").alias("id"), F.coalesce("kids", "none").alias("children")).alias("t"))
    return below.select(F.col("node").alias("start"), F.col("t").alias("tree"))
