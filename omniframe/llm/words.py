"""Vectorised word handling on Arrow batches.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; a null
text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside one Arrow batch.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - 1).clip(0) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, n]):
            yield batch.slice(int(a), int(b - a))
        # workers live on from task to task; what Arrow holds in reserve goes back
        pa.default_memory_pool().release_unused()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the n + 1 offsets of each text's words."""
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False).astype(bool)
    at = np.concatenate([[0], np.cumsum(counts)])
    seen = np.concatenate([[0], np.cumsum(keep)])
    return flat.filter(full), seen[at]


def encode(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's code, and the distinct words by code."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each distinct word's UTF-8 bytes."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), for uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The text's number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """For each word: whether ``width`` words of the same text begin there."""
    n = int(offsets[-1])
    end = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n) + width <= end


def bounded_sample(rows: DataFrame, key: Column, most: int, ties: list[str]) -> DataFrame:
    """At most ``most`` rows, those whose key's hash is smallest.

    A threshold that leaves about twice that many is worked out from the number of rows first,
    so no task hands on more than its share of them, however many tasks there are.
    """
    n = rows.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
    cut = (1 << 40) if n <= 3 * most else (2 * most << 40) // n
    return rows.withColumn("chosen", place).filter(F.col("chosen") < cut).orderBy("chosen", *ties).limit(most)
