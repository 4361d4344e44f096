"""Near copies of texts: five-word shingles whose overlap (Jaccard) is LEAST or more.

SimHash links the closest copies first (see simhash.keep_one, which hands its groups in). It cannot
serve all of this: at an overlap of 0.8 two 64-bit fingerprints differ by
some ten bits, a radius that no index by deletion variants covers. So candidates are also
texts that agree in all ``ROWS`` minima of one of ``BANDS`` bands of a MinHash (a
pair at 0.8 is missed with a chance of 0.00036, a closer one less often). Every link is
verified on the shingles of both texts, so nothing below ``LEAST`` is linked.

A bucket of candidates is not expanded into pairs. In ``ROUNDS`` rounds each bucket
chooses a member by a hash of member, bucket and round, and those of its members that are not yet in
the chosen one's component are verified against it; a text is in up to BANDS buckets and so
meets as many others a round. What is still in different components of one
bucket after that is compared in blocks of ``BLOCK`` members inside
the tasks, by parities: shingles are dealt to ``FINE`` places, and a bit a place says whether
an odd number of a text's shingles is there. Two texts differ in at least as many shingles as in
bits, so a pair whose bits differ too much is surely below ``LEAST``; the other pairs
of different components leave and are verified. So the components are those
of all candidate pairs, none is lost, and rows grow with a bucket's members, not with their square.

Texts with the same set of shingles are one node (64 bits of hash over the set).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omniframe.llm import durable, words
from omniframe.llm.components import components

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
ROUNDS = 3
BLOCK = 256
FINE = 4096
_PICK = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the offsets of each text's; fewer words than WIDTH are one shingle."""
    flat, at = words.split(pc.ascii_lower(texts))
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    code, distinct = words.encode(flat)
    h = words.hashes(distinct)[code]
    size = np.diff(at)
    count = np.where(size >= WIDTH, size - WIDTH + 1, (size > 0).astype(np.int64))
    bound = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(bound[-1]) + np.repeat(at[:-1] - bound[:-1], count)
    n = np.repeat(np.minimum(size, WIDTH), count)
    out = n.astype(np.uint64)
    for i in range(WIDTH):
        inside = n > i
        out[inside] = words.mix(out[inside] + h[first[inside] + i])
    return out, bound


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's node, its number of distinct shingles, its band keys (a row a text), and 16 bits of each minimum."""
    h, bound = shingles(texts)
    node, size = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    for i, (a, z) in enumerate(zip(bound[:-1], bound[1:])):
        own = np.unique(h[a:z])
        node[i], size[i] = xxhash.xxh64_intdigest(own.tobytes()), len(own)
    keys, minima = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), BANDS * ROWS), np.uint16)
    full = np.flatnonzero(np.diff(bound))
    if len(full):
        for j, (x, y) in enumerate(_PICK.T):
            low = np.minimum.reduceat((h ^ x) * (y | np.uint64(1)), bound[:-1][full])
            keys[full, j // ROWS] = words.mix(keys[full, j // ROWS] + low + np.uint64(j))
            minima[full, j] = (words.mix(low) >> np.uint64(48)).astype(np.uint16)
    return node, size, keys, minima


def sketches(docs: DataFrame, key: str, prints: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """(key, node, size, bands, fp) of every row; a text without words has no bands; fp is null without ``prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches):
            node, size, keys, _ = sketch(b.column("text"))
            fp = pa.array(prints(b.column("text")).view(np.int64)) if prints else pa.nulls(len(node), pa.int64())
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys[size > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pa.array(size), bands, fp], names=["key", "node", "size", "bands", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, node long, size long, bands array<long>, fp long")


def parities(texts: pa.Array) -> np.ndarray:
    """A row of FINE bits for each text: whether an odd number of its distinct shingles is dealt to a place."""
    h, bound = shingles(texts)
    out = np.zeros((len(texts), FINE // 8), np.uint8)
    for i, (a, z) in enumerate(zip(bound[:-1], bound[1:])):
        place = (words.mix(np.unique(h[a:z])) % np.uint64(FINE)).astype(np.int64)
        out[i] = np.packbits((np.bincount(place, minlength=FINE) & 1).astype(np.uint8))
    return out


def fine_sketches(texts: DataFrame) -> DataFrame:
    """(node, fine): the parities of a node's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in parities(b.column("text"))], pa.binary())], names=["node", "fine"])

    return texts.select("node", "text").mapInArrow(run, "node long, fine binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles overlap by LEAST or more."""

    def sets(nodes: list, column: pa.Array) -> dict[int, np.ndarray]:
        at = {n: i for i, n in enumerate(nodes)}
        h, bound = shingles(column.take(pa.array(list(at.values()), pa.int64())))
        return {n: np.unique(h[bound[i] : bound[i + 1]]) for i, n in enumerate(at)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in words.chunks(batches, "text_b"):
            for part in words.chunks(iter([c]), "text_a"):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                left, right = sets(a, part.column("text_a")), sets(b, part.column("text_b"))
                near = []
                for x, y in zip(a, b):
                    both = len(np.intersect1d(left[x], right[y], True))
                    near.append(both >= LEAST * (len(left[x]) + len(right[y]) - both))
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    own = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = own.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and pair of blocks; pairs of members of different components that may be near by their parities."""

    def done(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        node, root, size, side = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        bands = np.array([r[4] for r in rows], np.int64)
        fine = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
        band, same_block = rows[0][6], rows[0][7]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same_block else 1))
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left.tolist():
            j = right[(root[right] != root[i]) & (np.minimum(size[right], size[i]) >= LEAST * np.maximum(size[right], size[i]))]
            if same_block:
                j = j[j > i]
            differ = np.bitwise_count(fine[j] ^ fine[i]).sum(axis=1, dtype=np.int64)
            j = j[differ * (1 + LEAST) <= (size[j] + size[i]) * (1 - LEAST) + 1e-6]
            # a pair leaves from the first band that it shares
            first = (bands[j] == bands[i]).argmax(axis=1) if len(j) else j
            j = j[first == band]
            out[0].append(np.full(len(j), node[i]))
            out[1].append(node[j])
        a, b = np.concatenate(out[0]), np.concatenate(out[1])
        return np.minimum(a, b), np.maximum(a, b)

    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("k", "i", "j", "node", "root", "size", "side", "bands", "fine", "band"))):
            if row[:3] != now and held:
                a, z = done(held)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])
                held = []
            now = row[:3]
            held.append((*row[3:], row[1] == row[2]))
    if held:
        a, z = done(held)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])


def near_roots(prints: DataFrame, docs: DataFrame, by: list[str], met: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that are near another one.

    prints has node, size, bands and the columns ``by``, which name a row of docs with that text;
    met has pairs (a, b) of nodes that are verified before any others.
    """
    nodes = durable.save(prints.filter("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct(*by)).alias("row")), "nodes")
    listed = nodes.select("node", F.posexplode("bands").alias("band", "k"))
    keys = listed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = durable.save(listed.join(keys, "k"), "members")
    wanted = held.select("node")
    if met is not None:
        wanted = wanted.union(met.select("a")).union(met.select("b"))
    rows = nodes.join(wanted.distinct(), "node", "left_semi").select("node", *[F.col(f"row.{c}").alias(c) for c in by])
    # rows that are equal in every column have one text
    texts = docs.select(*by, "text").join(rows, by).groupBy("node").agg(F.first("text").alias("text"))
    texts = durable.save(texts, "texts")
    links, roots = None, None

    def still_open() -> DataFrame:
        """The members of buckets that hold more than one component."""
        named = durable.save(held.join(roots, "node", "left").select("k", "node", "band", "n", F.coalesce("root", "node").alias("root")), "members")
        split = named.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("k")
        return durable.save(named.join(split, "k", "left_semi"), "open")

    if met is None:
        open_ = held.withColumn("root", F.col("node"))
    else:
        links = durable.save(verified(met, texts), "links")
        roots = durable.save(components(links), "roots")
        open_ = still_open()
    for turn in range(ROUNDS):
        # the chosen member of each bucket is a minimum, which combines before the shuffle
        pivot = open_.groupBy("k").agg(F.min(F.struct(F.xxhash64("node", "k", F.lit(turn)).alias("h"), "node", "root")).alias("p"))
        pairs = open_.join(pivot.select("k", F.col("p.node").alias("pivot"), F.col("p.root").alias("other")), "k").filter("root != other")
        found = durable.save(verified(pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), texts), "links")
        links = found if links is None else links.union(found)
        roots = durable.save(components(links), "roots")
        open_ = still_open()
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    fine = fine_sketches(texts.join(open_.select("node").distinct(), "node", "left_semi"))
    dealt = open_.join(nodes.select("node", "size", "bands").join(fine, "node"), "node").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    # each member goes with its block to every pair of blocks that its block is in
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("k", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "root", "size", "bands", "fine", "band")
    rest = spread.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(_unlike, "a long, b long")
    more = durable.save(verified(durable.save(rest, "pairs").distinct(), texts), "links")
    return durable.save(components(links.union(more)), "roots")
