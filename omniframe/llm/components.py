"""Connected components: local contraction, then large-star and small-star rounds.

Links are dealt evenly, by no key, to tasks of at most ``LOCAL_EDGES`` links; each task
replaces its share by a forest of stars to the smallest node (labels hooked and
pointers jumped in numpy). Components that fall into several shares are joined by
rounds of equality joins and minima, which combine before the shuffle, each
followed by another contraction. Every step's links are written to the shared
folder, so neither lineage, driver memory nor a task grows with the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omniframe.llm import durable

#: The most links that one task contracts at a time.
LOCAL_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, and that smallest node."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        high, low = np.maximum(x, y), np.minimum(x, y)
        open_ = high != low
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def done() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 2 * LOCAL_EDGES:  # more than was dealt out: what is held is contracted on its own
            yield done()
            held, n = [], 0
    if n:
        yield done()


def _local(edges: DataFrame, n: int) -> DataFrame:
    return edges.select("a", "b").repartition(max(1, -(-n // LOCAL_EDGES))).mapInArrow(_contract, "a long, b long")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star, then one small-star, over edges (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    # the larger neighbours of each node now point at its smallest neighbour
    star = both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    root = star.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    return star.join(root, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; edges (a, b) of longs.

    The root is a component's smallest node. Self-links, repeated links and
    links in both directions are allowed; null ends are ignored.
    """
    now = durable.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b AND a IS NOT NULL AND b IS NOT NULL"), "edges")
    n = now.count()
    shares = -(-n // LOCAL_EDGES)
    new = durable.save(_local(now, n), "edges")
    durable.drop(now)
    now = new
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    while shares > 1:  # one share has seen every link
        seen = mark(now)
        new = durable.save(_round(now), "edges")
        if mark(new) == seen:
            durable.drop(new)
            break
        durable.drop(now)
        now = durable.save(_local(new, new.count()), "edges")
        durable.drop(new)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
