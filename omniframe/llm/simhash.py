"""Operator 3: SimHash fingerprints and near-duplicate groups by deletion variants.

Two 64-bit fingerprints at distance 2 or less, cut into two 32-bit segments,
differ by at most one bit in one of the segments. So each fingerprint is
indexed under 64 keys: for each segment and each of its bits, the segment with
that bit struck out. Fingerprints that share a key are compared.

A key that three or more distinct fingerprints share (only groups of near
copies do that) is not expanded into pairs. Its members are linked through
midpoints instead: fingerprints are at distance 2 or less exactly if some
64-bit value is within one bit of both, so each member is listed under
itself and its 64 one-bit neighbours. A midpoint has 65 members at most, all
within distance 2 of each other, and a star to the smallest joins them. No
link is lost and the work stays in proportion to the members.

Only distinct fingerprints take part; exact copies ride along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omniframe.llm import durable, minhash, words
from omniframe.llm.components import components

#: Crowded keys (a long each) up to which they are broadcast; beyond, they are joined by shuffling.
MOST_BROADCAST = 1_000_000
#: A fingerprint that more than one row in so many has is joined by broadcast; there are at most so many of them.
CROWDED = 10_000


def simhash(texts: pa.Array, width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints (uint64) of whole texts: a bit is set if it is in over half of the shingles' hashes."""
    flat, at = words.split(pc.ascii_lower(texts))
    out = np.zeros(len(texts), np.uint64)
    size = np.diff(at)
    if not len(flat):
        return out
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.cumsum(length + 1) - 1
    begin = stop - length
    # a text of fewer words than the width has one shingle: all its words
    count = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    bound = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(bound[-1]) + np.repeat(at[:-1] - bound[:-1], count)
    last = first + np.repeat(np.minimum(size, width), count) - 1
    blob = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.binary())), b" ")[0].as_py()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(blob[a:b], seed) for a, b in zip(begin[first].tolist(), stop[last].tolist())), np.uint64, len(first))
    full = np.flatnonzero(count)
    for j in range(64):
        ones = words.per_row((h >> np.uint64(j) & np.uint64(1)).astype(np.int64), bound)
        out[full] |= (2 * ones[full] > count[full]).astype(np.uint64) << np.uint64(j)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a signed long; zero for a null text or one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash(b.column("text"), width).view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, k): 64 keys each; k holds the struck bit's number above the segment's other bits."""
    part = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    k = F.expr("shiftleft(i, 32) | (part & ~shiftleft(1L, cast(i % 32 as int)))")
    return fps.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i")).select("fp", "i", part.alias("part")).select("fp", k.alias("k"))


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` at distance 2 or less."""
    if most != 2:
        raise ValueError("two segments with one struck bit each serve distance 2")
    keys = _variants(fps).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    keys = durable.save(keys, "variant-keys")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = keys.filter("n = 2").select("a", "b").filter(near).distinct()
    many = keys.filter("n > 2").select("k")
    if many.count() <= MOST_BROADCAST:
        many = F.broadcast(many)
    crowded = _variants(fps).join(many, "k", "left_semi").select("fp").distinct()
    mid = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    mid = mid.select("fp", F.expr("if(i < 0, fp, fp ^ shiftleft(1L, greatest(i, 0)))").alias("z"))
    star = mid.select(F.col("fp").alias("b"), F.min("fp").over(Window.partitionBy("z")).alias("a"))
    return pairs.union(star.filter("a < b").select("a", "b").distinct())


def near_groups(prints: DataFrame, key: str = "key") -> DataFrame:
    """(fp, root, component_id, n_rows) of every distinct fingerprint.

    root is a fingerprint that stands for its whole component, component_id the
    smallest key in it; null keys count only where all are null.
    """
    own = durable.save(prints.groupBy("fp").agg(F.min(key).alias("own"), F.count(F.lit(1)).alias("n_rows")), "distinct-prints")
    roots = durable.save(components(links(own.select("fp"))), "roots")
    merged = roots.join(own, F.col("node") == F.col("fp"))
    best = merged.groupBy("root").agg(F.min("own").alias("best"))
    named = merged.select("fp", "root").join(best, "root").select("fp", "root", "best")
    return own.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("best", "own").alias("component_id"), "n_rows")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document; odd rows as in ``assign``."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def assign(docs: DataFrame) -> DataFrame:
    """One row per document, repeated rows and null ids included.

    Null and empty texts have fingerprint zero and are linked like any other; a
    component of null ids alone has a null component_id; an empty table gives no row; other columns are ignored.
    """
    prints = durable.save(fingerprints(docs), "prints")
    groups = durable.save(near_groups(prints).select("fp", "component_id", "n_rows"), "groups")
    total = prints.count()
    crowded = F.broadcast(groups.filter(F.col("n_rows") > total // CROWDED + 1))
    # a fingerprint that many rows share is not shuffled with them
    many = prints.join(crowded, "fp")
    few = prints.join(crowded.select("fp"), "fp", "left_anti").join(groups, "fp")
    out = many.select("fp", "key", "component_id").union(few.select("fp", "key", "component_id"))
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp): each node of a group of near fingerprints with the group's smallest."""
    own = durable.save(prints.select("node", "fp").distinct(), "print-nodes")
    groups = durable.save(near_groups(own, "node").select("fp", F.col("component_id").alias("a")), "print-groups")
    return durable.save(own.join(groups, "fp").select("a", F.col("node").alias("b")).filter("a != b"), "print-pairs")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near copies, the document with the smallest doc_id stays.

    Texts are near if their five-word shingles overlap by minhash.LEAST or more. Fingerprints of the same
    shingles at distance 2 or less, found by deletion variants, are the first candidates; an
    overlap of LEAST goes with some ten bits, so all that is left is looked for by MinHash. Every link is verified on both texts.
    Null ids come last; ties go to the smaller hash of the whole row, and of
    rows that are equal in every column one stays (null and empty values differ). A text without words
    is near those without words only. All columns are kept, whatever their names, and
    documents that are near no other stay as they are; an empty table stays empty.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    whole = [x for c in cols for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    row = docs.select(F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2"), "doc_id", "text", F.struct(*cols).alias("row"))
    shown = row.select(F.struct("doc_id", "k1", "k2").alias("key"), "text")
    prints = durable.save(minhash.sketches(shown, "key", lambda texts: simhash(texts, minhash.WIDTH)).select("node", "size", "bands", "fp", "key.doc_id", "key.k1", "key.k2"), "prints")
    groups = minhash.near_roots(prints, row.select("k1", "k2", "text"), ["k1", "k2"], near_copies(prints.filter("size > 0")))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2")
    # copies are combined before any shuffle: by text, then by group
    best = prints.groupBy("node").agg(F.min(rank).alias("r")).join(groups, "node", "left")
    first = best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r")).select("r.k1", "r.k2")
    once = row.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return once.join(first, ["k1", "k2"], "left_semi").select("row.*")
