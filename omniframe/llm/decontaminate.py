"""Operator 8: benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters, digits and marks. A document and a
benchmark item, laid side by side without gaps, overlap if some stretch of at
least ``MIN_WORDS`` words (the whole item, if it is shorter) has an equal share
of ``MIN_EQUAL`` or more; replaced words are tolerated wherever they stand.

A spaced seed is a window of words of which a fixed mask looks at some
positions and ignores the others, so a replaced word at an ignored position
leaves the seed's hash as it was. The masks lose no overlap: a stretch of any length
with that share can be cut into pieces of 13 to 25 words of which one has it too,
and of every way to replace a fifth of the words of such a piece each leaves
a seed of one of the masks whole (a test goes through them all). Items of fewer than
``MIN_WORDS`` words have seeds of their own: of n words with k replaced, n // (k + 1) in a row are equal.

Seeds of every benchmark item and of every position of every document are joined
on their hash; hits are reduced to one alignment per document, item and
diagonal, and each alignment is verified word by word.

The benchmark is the query set: it is joined in blocks of a bounded number of
words, and each block is a sorted table of hashes that goes to all tasks. The
documents are never shuffled, so a benchmark passage that a third of all
documents share costs no more than any other. A larger benchmark means more
blocks, not a larger table. Hits are expanded and verified in parts of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import words

#: Fixed masks (1: the word counts).
MASKS = ("11101011", "11001000111", "1101011001", "111111")
#: An overlap counts from so many words on, or the whole item if it is shorter.
MIN_WORDS = 13
#: Share of an overlap's words that must be equal, as a fraction of whole numbers.
EQUAL, OF = 4, 5
#: Words of the benchmark in one block; a longer item is cut into pieces that overlap by PIECE words.
BLOCK_WORDS = 2_000_000
PIECE = 25
#: Hits expanded, and words compared, at a time.
PART = 1 << 20
FOUND = "doc_id long, item_id long, n_equal long, n_overlap long, doc_start long, item_start long"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every normalised word, and the offsets of each text's words."""
    low = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL\pN\pM]+", " "))
    flat, at = words.split(low)
    if not len(flat):
        return np.zeros(0, np.uint64), at
    code, distinct = words.encode(flat)
    return words.hashes(distinct)[code], at


def seeds(h: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask's windows that lie within one text, and where they begin."""
    where = np.flatnonzero(words.starts(at, len(mask)))
    n = len(h) - len(mask) + 1
    if n <= 0 or not len(where):
        return np.zeros(0, np.uint64), where[:0]
    out = np.zeros(n, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) | 1) & (1 << 64) - 1)
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return out[where], where


def short_mask(n: int) -> str:
    """The mask of an item of n words, n below MIN_WORDS."""
    return "1" * (n // (n - -(-n * EQUAL // OF) + 1))


class Block:
    """Some benchmark items (or pieces of long ones): their words, and their seeds sorted by hash."""

    def __init__(self, ids: list, first: list[int], parts: list[np.ndarray]) -> None:
        self.ids, self.first = ids, np.array(first, np.int64)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.h, self.at = np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(self.size)])
        self.row = words.rows_of(self.at)
        long_ = self.size >= MIN_WORDS
        wanted = {m: long_ for m in MASKS}
        for n in sorted({*self.size[~long_].tolist()} - {0}):
            m = short_mask(n)
            wanted[m] = wanted.get(m, np.zeros(len(parts), bool)) | (self.size == n)
        self.tables = []
        for m, items in wanted.items():
            s, p = seeds(self.h, self.at, m)
            own = items[self.row[p]]
            s, p = s[own], p[own]
            if not len(s):
                continue
            o = np.argsort(s, kind="stable")
            s, p = s[o], p[o]
            # a seed that repeats right before in its item goes on a diagonal that a repeated seed of a document is already on
            head = np.ones(len(p), bool)
            back = np.zeros(len(self.h) + 1, np.uint64)
            known = np.zeros(len(self.h) + 1, bool)
            back[p + 1], known[p + 1] = s, True
            same = known[p] & (back[p] == s) & (self.row[p] == self.row[np.maximum(p - 1, 0)])
            head[same] = False
            bits = min(25, max(16, len(s).bit_length() + 4))
            maybe = np.zeros(1 << bits, bool)
            maybe[(s >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((m, s, p, head, bits, maybe))

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in the documents' words and in the block's words with equal seeds, in parts."""
        row = words.rows_of(at)
        for m, s, p, head, bits, maybe in self.tables:
            x, where = seeds(h, at, m)
            if not len(x):
                continue
            again = np.zeros(len(x), bool)
            again[1:] = (x[1:] == x[:-1]) & (where[1:] == where[:-1] + 1) & (row[where[1:]] == row[where[:-1]])
            may = np.flatnonzero(maybe[(x >> np.uint64(64 - bits)).astype(np.int64)])
            x, where, again = x[may], where[may], again[may]
            lo = np.searchsorted(s, x, "left")
            found = np.flatnonzero((lo < len(s)) & (s[np.minimum(lo, len(s) - 1)] == x))
            where, again, lo = where[found], again[found], lo[found]
            n = np.searchsorted(s, x[found], "right") - lo
            share = (np.cumsum(n) - 1) // PART
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(n)]
            for a, z in zip(cuts, cuts[1:]):
                k = n[a:z]
                i = np.repeat(lo[a:z], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                keep = head[i] | ~np.repeat(again[a:z], k)
                yield np.repeat(where[a:z], k)[keep], p[i[keep]]

    def alignments(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, diagonal) of all hits, each once in a part."""
        held: list[np.ndarray] = []
        n = 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, i, d = np.concatenate(held, axis=1)
            o = np.lexsort((d, i, r))
            r, i, d = r[o], i[o], d[o]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])
            return r[new], i[new], d[new]

        for d, b in self.hits(h, at):
            r, i = np.searchsorted(at, d, "right") - 1, self.row[b]
            held.append(np.stack([r, i, (d - at[r]) - (b - self.at[i])]))
            n += len(d)
            if n > 2 * PART:
                held = [np.stack(settled())]
                n = held[0].shape[1]
                if n > PART:
                    yield tuple(held[0])
                    held, n = [], 0
        if n:
            yield settled()

    def overlaps(self, h: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(overlap's words, equal words, where it begins in the document and in the item) of each (text, item) that overlap, the best of all alignments."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        length = np.diff(at)
        for r, i, d in self.alignments(h, at):
            lo, hi = np.maximum(0, -d), np.minimum(self.size[i], length[r] - d)
            need = np.minimum(MIN_WORDS, self.size[i])
            fits = hi - lo >= need
            r, i, d, lo, hi, need = (x[fits] for x in (r, i, d, lo, hi, need))
            share = np.cumsum(hi - lo + 1) // PART
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(r)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                size = hi[a:z] - lo[a:z]
                same, bound = self.compared(h, at, r[a:z], i[a:z], d[a:z], lo[a:z], size)
                equal = words.per_row(same.astype(np.int64), bound)
                good = np.flatnonzero(accepted(same, bound, need[a:z]))
                # the most promising first; those that cannot be longer, or longer in equal words, are left out
                good = good[np.lexsort((lo[a:z][good] + d[a:z][good], -equal[good], -size[good]))]
                for key, k in zip(zip(r[a:z][good].tolist(), i[a:z][good].tolist()), good.tolist()):
                    known = out.get(key)
                    q = int(lo[a + k])
                    if known and (int(size[k]), int(equal[k]), -(q + int(d[a + k]))) < known[:3]:
                        continue
                    first, last = longest(same[bound[k] : bound[k + 1]])
                    got = (last - first, int(same[bound[k] + first : bound[k] + last].sum()), -(q + first + int(d[a + k])), -(q + first + int(self.first[i[a + k]])))
                    if not known or got > known:
                        out[key] = got
        return {k: (n, same, -x, -y) for k, (n, same, x, y) in out.items()}

    def compared(self, h: np.ndarray, at: np.ndarray, r: np.ndarray, i: np.ndarray, d: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are equal, alignment after alignment, and the alignments' offsets in them."""
        bound = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(bound[-1]) - np.repeat(bound[:-1], size)
        return self.h[np.repeat(self.at[i] + lo, size) + step] == h[np.repeat(at[r] + lo + d, size) + step], bound


def scores(same: np.ndarray) -> np.ndarray:
    """Running sums that rise by one share for an equal word: a stretch has the share MIN_EQUAL if its sum isn't negative."""
    return np.concatenate([[0], np.cumsum(np.where(same, OF - EQUAL, -EQUAL))])


def accepted(same: np.ndarray, bound: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each alignment: whether a stretch of at least ``need`` words has the share of equal words."""
    size = np.diff(bound)
    if not len(same):
        return np.zeros(len(size), bool)
    # one running sum per alignment, with a place for its start; a later alignment lies below all earlier ones
    start = bound[:-1] + np.arange(len(size))
    total = scores(same)
    inner = np.arange(int(bound[-1]) + len(size)) - np.repeat(np.arange(len(size)), size + 1)
    drop = np.repeat(np.arange(len(size)) * np.int64(2 * OF * (int(size.max()) + 1)), size + 1)
    score = total[inner] - np.repeat(total[bound[:-1]], size + 1) - drop
    low = np.minimum.accumulate(score)
    place = np.arange(len(score)) - np.repeat(start, size + 1)
    far = np.repeat(need, size + 1)
    ends = np.flatnonzero(place >= far)
    good = ends[score[ends] >= low[ends - far[ends]]]
    out = np.zeros(len(size), bool)
    out[np.searchsorted(start, good, "right") - 1] = True
    return out


def longest(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch with the share of equal words (the first of the longest), without the replaced words at its ends."""
    score = scores(same)
    low = np.minimum.accumulate(score)
    first = np.searchsorted(-low, -score, "left")
    z = int(np.argmax(np.arange(len(score)) - first))
    inside = np.flatnonzero(same[first[z] : z]) + first[z]
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The items in blocks of a bounded number of words, read one partition at a time."""
    ids, first, parts, n = [], [], [], 0
    for r in benchmark.select(F.col(key).cast("long"), text).filter(F.col(text).isNotNull()).toLocalIterator():
        h, _ = word_hashes(pa.array([r[1]], pa.string()))
        step = BLOCK_WORDS - PIECE
        for a in range(0, max(1, len(h) - PIECE), step):
            piece = h[a : a + BLOCK_WORDS]
            if parts and n + len(piece) > BLOCK_WORDS:
                yield Block(ids, first, parts)
                ids, first, parts, n = [], [], [], 0
            ids.append(r[0])
            first.append(a)
            parts.append(piece)
            n += len(piece)
    if parts:
        yield Block(ids, first, parts)


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that overlap: the longest overlap of all alignments (most equal words, then the earliest, of equals).

    n_overlap words of the document, from its word doc_start, face those of the
    item from item_start; n_equal of them are equal. Null and empty texts (of
    either table) match nothing; repeated rows each give their rows; empty tables
    give none; other columns are ignored. An item of more than BLOCK_WORDS words gives a row for each piece that overlaps.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = None
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            b = sent.value
            for part in words.chunks(batches):
                best = b.overlaps(*word_hashes(part.column("text")))
                ids = part.column("key").to_pylist()
                got = [(ids[r], b.ids[i], same, n, x, y) for (r, i), (n, same, x, y) in sorted(best.items())]
                cols = list(zip(*got)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in FOUND.split(", ")])

        found = rows.mapInArrow(run, FOUND)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the overlap of every document with every benchmark item it holds; odd rows as in ``overlaps``."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return overlaps(docs, bench)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that overlap no benchmark item, all columns kept, judged row by row without a shuffle.

    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty; columns may have any names.
    """
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for part in words.chunks(batches):
                left = np.ones(part.num_rows, bool)
                left[[r for r, _ in sent.value.overlaps(*word_hashes(part.column("text")))]] = False
                yield part.filter(pa.array(left))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
