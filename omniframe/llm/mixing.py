"""Operator 5: mixing sources to target weights, with DataFrame functions only.

The words of each source are summed, targets are found by filling the sources
by weight up to a multiple of their size, and each document is taken
floor(rate) times and once more with probability rate - floor(rate), decided by
a hash of its id.

The per-source sums combine before the shuffle, so a source that holds a third
of all rows costs no more than another. The table of sources is broadcast only
if it was counted and is small; otherwise the documents are joined to it by
an equality join whose hot side adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omniframe.llm import durable

WORD = r"[^ \t-\r]+"
#: Sources up to which their table (a name and two numbers each) is broadcast.
MOST_BROADCAST = 10_000


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    total size. No target exceeds ``most`` times its source's size: what is
    above is shared again by weight until none is. The windows see one narrow row a
    source (a million sources are some 50 MB in one task). That fixed point is a
    filling to one level (words a unit of weight), found in one sorted pass:
    sources in order of the level at which they are full, the first k of them full.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sums.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("w_rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the level if exactly the sources before this one are full
    level = F.col("rest") / F.col("w_rest")
    t = t.withColumn("rest_k", F.first(F.when(level <= F.col("full_at"), F.struct("rest", "w_rest", "full_at")), True).over(every))
    open_ = F.col("full_at") >= F.col("rest_k.full_at")
    return t.select("source", "source_size", F.least("cap", F.when(open_, F.col("w") * F.col("rest_k.rest") / F.col("rest_k.w_rest")).otherwise(F.col("cap"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id (null counts as its own id)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_targets(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Each row with its source's size and target; a null source matches the null source."""
    table = table.select(F.col("source").alias("_s"), "source_size", "target")
    if table.count() <= MOST_BROADCAST:
        table = F.broadcast(table)
    return rows.join(table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def copies(size: Column, source_size: Column, target: Column, key: Column, seed: int) -> Column:
    """How many times a document is taken."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + (uniform(key, seed) < rate - whole).cast("long")).cast("long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    A null or empty text has size 0; null sources are one source (the last); null ids are one id; repeated rows are
    taken alike; an empty table gives no row; other columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = durable.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    out = with_targets(sizes, durable.save(targets(sizes), "targets"))
    n = copies(F.col("size"), F.col("source_size"), F.col("target"), F.col("doc_id"), 5)
    return out.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 5, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Every document as many times as the mix takes it, all columns kept.

    Null texts have no words; a source without words is taken zero times; an
    empty table stays empty. Null sources are one source, null ids one id; equal rows with one id
    are taken alike. Columns may have any names.
    """
    row = docs.select("source", "doc_id", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    table = durable.save(targets(row.select("source", "size"), weights, most), "targets")
    n = copies(F.lit(0), F.col("source_size"), F.col("target"), F.col("doc_id"), seed)
    times = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.expr("array()").cast("array<bigint>"))
    return with_targets(row.select("source", "doc_id", "row"), table).select("row", F.explode(times).alias("time")).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM d GROUP BY source
), t AS (
  SELECT source, source_size, CAST([1.0, 2.0, 3.0][1 + k % 3] AS DOUBLE) AS w, source_size * CAST(3.0 AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, cap / w AS full_at FROM t
), r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM l
), f AS (
  SELECT rest, w_rest, full_at FROM r WHERE rest / w_rest <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1
), g AS (
  SELECT r.source, r.source_size, CASE WHEN r.full_at >= f.full_at THEN least(r.cap, r.w * f.rest / f.w_rest) ELSE r.cap END AS target FROM r, f
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('5:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken FROM p
"""
