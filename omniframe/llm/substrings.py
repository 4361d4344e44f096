"""Operator 6: substring dedup with a count-min prefilter.

Words covered by a window of 35 words whose sequence also starts elsewhere are
removed. Exactly grouping every window of a corpus would shuffle a row per
word, so a count-min sketch first finds the windows that may repeat:

1. Each window is counted under its anchor, the 8-gram with the smallest hash in
   it. Equal windows have equal anchors at equal offsets, so an anchor occurs
   at least as often as any window it stands for, and neighbouring windows
   mostly share one, which leaves about one counter update in 14 words.
   Each partition's sketch (two rows of hashed counters, which need to tell
   only 0, 1 and more) leaves as sorted positions; they are summed by
   slice of the counters into two bitmaps of "more than once".
2. A second pass looks the anchor of every window up. Estimates are never below
   the true counts, so no repeated window is lost. What is left is
   grouped by 128 bits of two independent hashes of the window. Windows seen twice within
   one block of documents are settled there and leave one row for the rest, so
   a passage that a third of the documents share is pre-aggregated.
3. Each document's repeated windows are brought to its text.

The sketch has eight counters an anchor, up to 2 ** 30 a row; both bitmaps
together then hold 256 MB, the bound of what is broadcast. Beyond that more
windows pass to the exact grouping; the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omniframe.llm import durable, words

WIDTH = 35
GRAM = 8
POSITION_BITS = 30
SLICE_BITS = 6  # slices of each of the sketch's two rows
LEAST_BITS = 20
PER_ANCHOR = 8


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every i with a whole window."""
    out, done = x, 1
    while 2 * done <= width:
        out, done = pick(out[:-done], out[done:]), 2 * done
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, each window's anchor (a hash), and the anchors at the places where they occur."""
    where = np.flatnonzero(words.starts(at, width))
    none = np.zeros(0, np.uint64)
    if not len(where):
        return where, none, none
    gram = min(GRAM, width)
    n = len(h) - gram + 1
    g = np.zeros(n, np.uint64)
    for k in range(gram):
        g = words.mix(g + h[k : k + n]) if k % 4 == 3 or k == gram - 1 else (g + h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    g |= np.uint64(1)
    span = width - gram + 1
    low = _slide(g, span, np.minimum)
    valid = np.zeros(len(low), bool)
    valid[where] = True
    seen = np.where(valid, low, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    chosen = _slide(np.concatenate([pad, seen, pad]), span, np.maximum) == g
    return where, low[where], g[chosen]


def _counters(anchor: np.ndarray) -> list[np.ndarray]:
    """The anchor's position in each of the sketch's rows."""
    shift = np.uint64(64 - POSITION_BITS)
    return [(words.mix(anchor + np.uint64(seed)) >> shift).astype(np.uint32) for seed in (0x51ED27, 0xC0FFEE)]


def _hashes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, at = words.split(texts)
    code, distinct = words.encode(flat)
    one = words.hashes(distinct)
    return one[code] if len(code) else np.zeros(0, np.uint64), at, code


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sorted counter positions of a partition's anchors, by slice; a position that occurs more often appears twice."""
    held: list[list[np.ndarray]] = [[], []]
    count = 0

    def flush() -> pa.RecordBatch:
        slices, sizes, data = [], [], []
        for r in (0, 1):
            p = np.sort(np.concatenate(held[r]))
            # keep the first two of each run of equal positions
            third = np.zeros(len(p), bool)
            third[2:] = (p[2:] == p[1:-1]) & (p[1:-1] == p[:-2])
            p = p[~third]
            cut = np.searchsorted(p >> np.uint32(POSITION_BITS - SLICE_BITS), np.arange((1 << SLICE_BITS) + 1))
            for s in range(1 << SLICE_BITS):
                part = p[cut[s] : cut[s + 1]]
                if len(part):
                    slices.append(r << SLICE_BITS | s)
                    sizes.append(len(part))
                    data.append(np.diff(part, prepend=np.uint32(0)).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["slice", "n", "data"])

    for b in words.chunks(batches):
        h, at, _ = _hashes(b.column("text"))
        for own, p in zip(held, _counters(anchors(h, at, width)[2])):
            own.append(p)
        count += len(held[0][-1])
        if count > 1 << 22:
            yield flush()
            held, count = [[], []], 0
    if count:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sums of the partitions' sketches: a bitmap of the counters above one, for each slice met here."""
    wide = 1 << bits - SLICE_BITS
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for s, data in zip(b.column("slice").to_pylist(), b.column("data").to_pylist()):
            p = np.cumsum(np.frombuffer(data, "<u4"), dtype=np.uint32) & np.uint32((1 << POSITION_BITS - SLICE_BITS) - 1)
            p = p >> np.uint32(POSITION_BITS - bits)
            own = sums.setdefault(s, np.zeros(2 * wide // 8, np.uint8))
            one, two = own[: wide // 8], own[wide // 8 :]
            at, n = np.unique(p, return_counts=True)
            byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
            again = (n > 1) | (one[byte] & bit > 0)
            np.bitwise_or.at(two, byte[again], bit[again])
            np.bitwise_or.at(one, byte, bit)
    for s, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own[wide // 8 :].tobytes()], pa.binary())], names=["slice", "bitmap"])


def sketch(docs: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Counter bits of a row, and both rows' bitmaps of counters above one."""
    parts = docs.select("text").mapInArrow(lambda it: _sketch(it, width), "slice int, n long, data binary")
    parts = durable.save(parts, "sketch")
    n = (parts.agg(F.sum("n")).first()[0] or 0) // 2
    bits = min(POSITION_BITS, max(LEAST_BITS, (max(n, 1) * PER_ANCHOR - 1).bit_length()))
    out = np.zeros((2, 1 << bits - 3), np.uint8)
    size = 1 << bits - 3 - SLICE_BITS
    merged = parts.select("slice", "data").repartition("slice").mapInArrow(lambda it: _merge(it, bits), "slice int, bitmap binary")
    for r in merged.toLocalIterator():
        row, s = r.slice >> SLICE_BITS, r.slice & (1 << SLICE_BITS) - 1
        out[row, s * size : (s + 1) * size] = np.frombuffer(r.bitmap, np.uint8)
    durable.drop(parts)
    return bits, out


def _window_hash(h: np.ndarray, where: np.ndarray, width: int, base: int) -> np.ndarray:
    """64-bit polynomial hash of ``width`` words' hashes from each start."""
    n = len(h)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:n], dtype=np.uint64)])
    return words.mix((total[where + width] - total[where]) * back[where])


FOUND = "h1 long, h2 long, doc_id long, row_key long, at int, settled binary"


def _candidates(batches: Iterator[pa.RecordBatch], width: int, sent) -> Iterator[pa.RecordBatch]:
    """Windows that may repeat: (h1, h2, at) rows to be grouped, and the starts of those settled here as one row a document."""
    bits, maps = sent.value
    for b in words.chunks(batches):
        flat, at = words.split(b.column("text"))
        code, distinct = words.encode(flat)
        if not len(code):
            continue
        h = words.hashes(distinct)[code]
        where, anchor, _ = anchors(h, at, width)
        may = np.ones(len(where), bool)
        for row, p in zip(maps, _counters(anchor)):
            p = p >> np.uint32(POSITION_BITS - bits)
            may &= row[p >> 3] & (np.uint8(128) >> (p & 7).astype(np.uint8)) > 0
        where = where[may]
        if not len(where):
            continue
        other = words.hashes(distinct, 1)[code]
        h1, h2 = _window_hash(h, where, width, 0x9E3779B97F4A7C15), _window_hash(other, where, width, 0xD6E8FEB86659FD93)
        o = np.lexsort((h2, h1))
        same = (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])
        fresh, known = np.ones(len(o), bool), np.zeros(len(o), bool)
        fresh[o[1:][same]] = False
        known[o[1:][same]] = known[o[:-1][same]] = True
        row = np.searchsorted(at, where, "right") - 1
        ids, keys = b.column("doc_id"), b.column("row_key")
        # one row a distinct window goes on
        pick = np.flatnonzero(fresh)
        take = pa.array(row[pick])
        n = len(pick)
        yield pa.RecordBatch.from_arrays([pa.array(h1[pick].view(np.int64)), pa.array(h2[pick].view(np.int64)), ids.take(take), keys.take(take), pa.array((where[pick] - at[row[pick]]).astype(np.int32)), pa.nulls(n, pa.binary())], names=[c.split()[0] for c in FOUND.split(", ")])
        done = np.flatnonzero(known)
        if len(done):
            rows, first = np.unique(row[done], return_index=True)
            local = (where[done] - at[row[done]]).astype("<i4")
            cut = [*first.tolist(), len(done)]
            data = [local[x:y].tobytes() for x, y in zip(cut, cut[1:])]
            take = pa.array(rows)
            k = len(rows)
            yield pa.RecordBatch.from_arrays([keys.take(take), pa.nulls(k, pa.int64()), ids.take(take), keys.take(take), pa.nulls(k, pa.int32()), pa.array(data, pa.binary())], names=[c.split()[0] for c in FOUND.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in words.chunks(batches):
        flat, at = words.split(b.column("text"))
        n = len(flat)
        cover = np.zeros(n + 1, np.int64)
        for i, (one, more) in enumerate(zip(b.column("ats"), b.column("settled"))):
            if one.is_valid:
                s = np.concatenate([one.values.to_numpy(zero_copy_only=False).astype(np.int64), *[np.frombuffer(x, "<i4").astype(np.int64) for x in more.as_py()]])
                s = np.unique(s) + at[i]
                cover[s] += 1
                cover[s + width] -= 1
        gone = np.cumsum(cover[:n]) > 0
        removed = words.per_row(gone.astype(np.int64), at)
        size = np.diff(at)
        kept = flat.filter(pa.array(~gone))
        bound = np.concatenate([[0], np.cumsum(size - removed)])
        lists = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), kept)
        text = pc.binary_join(lists, " ")
        sha = [hashlib.sha256(t).hexdigest() for t in text.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(removed), text, pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) and kept_sha256 of every row.

    Windows are judged on the input. A null text has no words; texts shorter
    than a window lose nothing; a repeated row repeats its windows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("row_key"))
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, width))
    found = docs.mapInArrow(lambda it: _candidates(it, width, sent), FOUND)
    found = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h1", "h2"))).filter("n > 1 or settled is not null")
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k")).agg(F.collect_list("at").alias("ats"), F.collect_list("settled").alias("settled"))
    rows = docs.join(found, (F.col("row_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return rows.select("doc_id", "text", "ats", "settled").mapInArrow(lambda it: _cut(it, width), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35
), k AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM p
), r AS (
  SELECT win FROM k GROUP BY win HAVING count(*) > 1
), s AS (
  SELECT DISTINCT k.doc_id, unnest(generate_series(k.i, k.i + 34)) AS j FROM k JOIN r USING (win)
), g AS (
  SELECT doc_id, list(j) AS gone FROM s GROUP BY doc_id
), o AS (
  SELECT d.doc_id, d.w, unnest(generate_series(1, len(d.w))) AS j FROM d
), kept AS (
  SELECT o.doc_id, string_agg(o.w[o.j], ' ' ORDER BY o.j) AS t FROM o ANTI JOIN s ON o.doc_id = s.doc_id AND o.j = s.j GROUP BY o.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
