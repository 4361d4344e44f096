"""Operator 9: quality rules and a calibrated n-gram classifier.

Hashed word n-grams (one and two words) and character n-grams (three and four code points)
feed a logistic regression, trained on labelled rows and calibrated on those
held back; whole texts are scored in Arrow batches against a fixed threshold.

The classifier is fitted on at most ``MOST_LABELLED`` labelled rows, chosen by a
hash of their id, so it does not depend on the order or partitioning of the
input. Their texts are turned into feature counts on the executors; of these at most
``MOST_FEATURES`` reach the driver, those of the first rows in the sample's order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import durable, words

#: Bytes of text handled at a time; character n-grams take some forty times that while they are scored.
CHUNK_BYTES = 2 << 20
#: The most feature counts (8 bytes each) that the classifier is fitted on.
MOST_FEATURES = 16_000_000
#: The most labelled rows that the classifier is fitted on.
MOST_LABELLED = 2000
BITS = 18
#: A document is kept if its calibrated probability of good quality is at least this.
KEEP_FROM = 0.5
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(code: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text: words that lie in a window of ``width`` words which occurs twice or more in that text."""
    n = len(code)
    start = np.flatnonzero(words.starts(at, width))
    covered = np.zeros(n + 1, np.int64)
    if len(start):
        row = words.rows_of(at)[start].astype(np.uint64)
        h = words.mix(row + np.uint64(1))
        for k in range(width):
            h = words.mix(h + code[start + k].astype(np.uint64) + np.uint64(1))
        o = np.argsort(h, kind="stable")
        same = h[o][1:] == h[o][:-1]
        a, b = start[o][1:][same], start[o][:-1][same]
        equal = row[o][1:][same] == row[o][:-1][same]
        for k in range(width):
            equal &= code[a + k] == code[b + k]
        twice = np.unique(np.concatenate([a[equal], b[equal]]))
        np.add.at(covered, twice, 1)
        np.add.at(covered, np.minimum(twice + width, n), -1)
    return words.per_row((np.cumsum(covered[:n]) > 0).astype(np.int64), at)


def dup_lines(texts: pa.Array) -> np.ndarray:
    """Per text: \\n-split lines that hold a word and equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), count)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False).astype(bool)
    code, distinct = words.encode(flat)
    row, code = row[full], code[full]
    once = np.unique(row * np.int64(max(len(distinct), 1)) + code) // max(len(distinct), 1)
    return np.bincount(row, minlength=len(texts)) - np.bincount(once, minlength=len(texts))


def base_counts(texts: pa.Array, flat: pa.Array, at: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """The columns of BASE."""
    chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    symbols = pc.fill_null(pc.count_substring_regex(texts, r"[#*$%&|<>]"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [np.diff(at), words.per_row(chars, at), symbols, dup_lines(texts), repeat_words(code, at)]


def slots(texts: pa.Array, at: np.ndarray, code: np.ndarray, distinct: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: slots of all its occurrences in order, each text's offsets in them, each text's total."""
    shift = np.uint64(64 - BITS + 2)
    wide = words.hashes(distinct) if len(distinct) else np.zeros(0, np.uint64)
    h = wide[code] if len(code) else wide
    size = np.diff(at)
    for width in (1, 2):
        x = h.copy()
        if width == 2:
            x[:-1] += words.mix(h[1:])
            x = x[words.starts(at, 2)]
        count = np.maximum(size - width + 1, 0)
        yield ((words.mix(x) >> shift).astype(np.int32) + ((width - 1) << BITS - 2), np.concatenate([[0], np.cumsum(count)]), count)
    texts = pc.fill_null(texts, "")
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    end = np.cumsum(length)
    for width in (3, 4):
        n = len(raw) - width + 1
        count = np.maximum(length - width + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(count)])
        if n <= 0:
            yield np.zeros(0, np.int32), offsets, count
            continue
        x = raw[:n].copy()
        for k in range(1, width):
            x = x * np.uint32(0x01000193) + raw[k : n + k]
        x *= np.uint32(2654435761)
        x ^= x >> np.uint32(15)
        x *= np.uint32(2246822519)
        inside = np.ones(n, bool)
        for k in range(1, width):
            cut = end[:-1] - k
            inside[cut[(cut >= 0) & (cut < n)]] = False
        # texts shorter than the window leave marks of several texts; count those that stand
        if int(inside.sum()) != int(count.sum()):
            owner = np.repeat(np.arange(len(length)), length)
            inside = owner[:n] == owner[width - 1 :]
        yield ((x[inside] >> np.uint32(32 - BITS + 2)).astype(np.int32) + ((width - 1) << BITS - 2), offsets, count)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -50, 50)))

    def score(self, texts: pa.Array, at: np.ndarray, code: np.ndarray, distinct: pa.Array) -> np.ndarray:
        raw = np.full(len(texts), self.bias)
        for s, offsets, count in slots(texts, at, code, distinct):
            raw += words.per_row(self.weight[s].astype(np.float64), offsets) / np.maximum(count, 1)
        return self.probability(raw)


FEATURES = "y double, chosen long, slot array<int>, value array<float>"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relative frequencies of each text's n-grams, as sparse rows."""
    for b in words.chunks(batches, most=CHUNK_BYTES):
        texts = b.column("text")
        flat, at = words.split(texts)
        code, distinct = words.encode(flat)
        own: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(b.num_rows)]
        for s, offsets, count in slots(texts, at, code, distinct):
            for i in range(b.num_rows):
                k, n = np.unique(s[offsets[i] : offsets[i + 1]], return_counts=True)
                own[i].append((k, n / max(int(count[i]), 1)))
        yield pa.RecordBatch.from_arrays(
            [b.column("y"), b.column("chosen"), pa.array([np.concatenate([k for k, _ in o]).astype(np.int32) for o in own], pa.list_(pa.int32())), pa.array([np.concatenate([v for _, v in o]).astype(np.float32) for o in own], pa.list_(pa.float32()))],
            names=["y", "chosen", "slot", "value"],
        )


#: Feature counts handled at a time while fitting.
BLOCK = 1 << 19


def margins(w: np.ndarray, slot: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Each row's sum of weights times values, a block of features at a time."""
    z = np.zeros(n)
    for k in range(0, len(slot), BLOCK):
        s = slice(k, k + BLOCK)
        z += np.bincount(row[s], w[slot[s]] * value[s], minlength=n)
    return z


def logistic(slot: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, fit: np.ndarray, steps: int = 120, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression on the rows of ``fit``, by full-batch adaptive gradient steps."""
    w, b = np.zeros(1 << BITS, np.float32), 0.0
    good = y[fit].mean()
    share = np.where(y > 0.5, 0.5 / max(good, 1e-9), 0.5 / max(1 - good, 1e-9)) / fit.sum() * fit
    seen, seen_b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = margins(w, slot, value, row, len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        gw = decay * w.astype(np.float64)
        for k in range(0, len(slot), BLOCK):
            s = slice(k, k + BLOCK)
            gw += np.bincount(slot[s], g[row[s]] * value[s], minlength=1 << BITS)
        gb = float(g.sum())
        seen += gw * gw
        seen_b += gb * gb
        w -= (rate * gw / (np.sqrt(seen) + 1e-9)).astype(np.float32)
        b -= 0.1 * gb / (seen_b**0.5 + 1e-9)
    return w, b


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid: slope and shift by Newton steps on smoothed targets."""
    good = y.sum()
    t = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    def loss(a: float, c: float) -> float:
        z = a * raw + c
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * a * a)

    a, c = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * raw + c, -50, 50)))
        g = np.array([((p - t) * raw).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p)
        hess = np.array([[(q * raw * raw).sum() + 1e-3, (q * raw).sum()], [(q * raw).sum(), q.sum() + 1e-6]])
        step, size, now = np.linalg.solve(hess, g), 1.0, loss(a, c)
        # a full step can overshoot where the curve is flat
        while size > 1e-6 and loss(a - size * step[0], c - size * step[1]) > now:
            size /= 2
        if size <= 1e-6:
            break
        a, c = a - float(size * step[0]), c - float(size * step[1])
    return a, c


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on up to ``most`` labelled rows; a fifth of them is held back for the calibration.

    Labels of repeated ids are averaged, null labels and null ids ignored; a repeated id's rows all
    count; null and empty texts have no features. Without labels of both kinds the model keeps everything.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = words.bounded_sample(chosen, F.col("doc_id"), most, ["doc_id"])
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("y", "chosen", "text")
    made = durable.save(rows.mapInArrow(features, FEATURES), "features")
    size = made.select("chosen", F.size("slot").alias("n")).toArrow().sort_by("chosen")
    # whole rows, as many as the bound allows (rows of one id stay together)
    within = np.cumsum(size.column("n").to_numpy()) <= MOST_FEATURES
    if not within.all():
        made = made.filter(F.col("chosen") < int(size.column("chosen")[int(np.argmin(within))].as_py()))
    got = made.toArrow().sort_by([("chosen", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 1.0, 1.0, 0.0)
    lists = got.column("slot").combine_chunks()
    row = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    slot = lists.flatten().to_numpy()
    value = got.column("value").combine_chunks().flatten().to_numpy()
    held = got.column("chosen").to_numpy() % 5 == 0
    del got, lists
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    w, b = logistic(slot, value, row, y, ~held)
    raw = margins(w, slot, value, row, len(y)) + b
    part = held if held.any() else ~held
    return Model(w, b, *calibrate(raw[part], y[part]))


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, key: str = "doc_id") -> DataFrame:
    """key, the columns of BASE, base_failed, quality (probability) and kept of every row.

    A null or empty text has no words and fails the base rules; repeated rows are judged
    alike, null keys like others; an empty table gives no row; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in words.chunks(batches, most=CHUNK_BYTES):
            texts = b.column("text")
            flat, at = words.split(texts)
            code, distinct = words.encode(flat)
            base = base_counts(texts, flat, at, code)
            failed = (base[0] < MIN_WORDS) | (100 * base[4] > MOST_REPEATED_PERCENT * base[0])
            p = m.score(texts, at, code, distinct)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in base], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_from))], names=["key", *[c.split()[0] for c in BASE.split(", ")], "base_failed", "quality", "kept"])

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return rows.mapInArrow(run, f"key {kind}, {BASE}, base_failed boolean, quality double, kept boolean").withColumnRenamed("key", key)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document; odd rows as in ``judge``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, train(docs, labels)).drop("quality")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that are kept, with all columns, judged in one pass and without a shuffle.

    Null and empty texts go (they fail the base rules), repeated rows stay or go together, an empty table stays empty; columns may have any names.
    """
    cols = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in words.chunks(batches, most=CHUNK_BYTES):
            texts = b.column("text")
            flat, at = words.split(texts)
            code, distinct = words.encode(flat)
            n, again = np.diff(at), repeat_words(code, at)
            good = (n >= MIN_WORDS) & (100 * again <= MOST_REPEATED_PERCENT * n) & (m.score(texts, at, code, distinct) >= KEEP_FROM)
            yield b.filter(pa.array(good))

    return docs.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, docs.schema)
