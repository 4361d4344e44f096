"""Operator 2: cross-entropy difference of two matched n-gram models.

A target model (documents labelled good and not toxic) and a background model
(all documents) have one order (words given the word before, a text's end
counted as a word), one smoothing and one vocabulary: all words of the
corpus and one unknown word. A document's score is the mean over its words of the loss under
the target model less the loss under the background model; the lower, the
more the document is like the target. A document is never scored by its own
words: its counts are left out of each model that has seen it.

Counts are those of all words and word pairs of all documents and grow with the corpus; nothing is
gathered at one place. Documents are put into chunks of a bounded size, kept compressed. A chunk's distinct
words and pairs are sent, by range of their hash (a slice), as sorted
differences with the chunk's own counts; a slice's task adds the chunks'
counts up and answers each chunk with the totals of what it asked for. A key
comes at most once from a chunk, however often it occurs, so no slice is hot. Then
each chunk meets its answers and is scored. Keys are hashes whose length follows the
size of the input (24 bits more than its bytes need), so that
counts of different keys practically never meet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import durable, words

#: Weights of the pair's, the word's and the uniform estimate; without a context seen before, the word's has the pair's too.
MIX = (0.55, 0.4, 0.05)
#: Bytes of text in one chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20
#: Bytes of text for each slice of the keys.
SLICE_BYTES = 8 << 20
#: Ids of target documents (8 bytes each) up to which they go to all tasks; beyond, the texts are joined to them by shuffling.
MOST_BROADCAST = 8_000_000
CODED = "chunk long, data binary"
ASKED = "slice int, chunk long, data binary"
ANSWERED = "chunk long, slice int, data binary, n_words long, n_all long, n_target long"
SCORED = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
END = np.uint64(0x5851F42D4C957F2D)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as bytes, each array in as many byte planes as its largest number needs."""
    out = []
    for a in arrays:
        planes = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        raw = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes]
        out += [struct.pack("<BQ", planes, len(a)), np.ascontiguousarray(raw.T).tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        planes, n = struct.unpack_from("<BQ", raw, at)
        a = np.zeros((n, 8), np.uint8)
        a[:, :planes] = np.frombuffer(raw, np.uint8, planes * n, at + 9).reshape(planes, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += 9 + planes * n
    return out


def pack_counts(n: np.ndarray) -> bytes:
    """Counts, most of which are small: a byte each, and the rest of those above 254."""
    big = np.flatnonzero(n > 254)
    return pack(np.minimum(n, 255), big, n[big])


def unpack_counts(parts: list[np.ndarray]) -> np.ndarray:
    small, big, rest = parts
    out = small.astype(np.int64)
    out[big.astype(np.int64)] = rest
    return out


class Chunk:
    """Coded texts: the distinct words' hashes, and for each word its number, texts one after the other, each that has words closed by END."""

    def __init__(self, vocabulary: np.ndarray, code: np.ndarray, size: np.ndarray, target: np.ndarray) -> None:
        self.vocabulary, self.size, self.target = vocabulary, size, target.astype(bool)
        u = len(vocabulary)
        self.at = np.concatenate([[0], np.cumsum(size + (size > 0))])
        self.now = np.full(self.at[-1], u, np.int64)
        last = self.at[1:][size > 0] - 1
        inner = np.ones(len(self.now), bool)
        inner[last] = False
        self.now[inner] = code
        # the word before; before the first stands END, which is counted once a text like any context
        self.before = np.roll(self.now, 1)
        self.first = self.at[:-1][size > 0]
        self.before[self.first] = u
        pairs, self.pair = np.unique(self.before * (u + 1) + self.now, return_inverse=True)
        h = np.append(vocabulary, END)
        keys = words.mix(h) & ~np.uint64(1)
        both = words.mix(words.mix(h[pairs // (u + 1)] + np.uint64(1)) * np.uint64(3) + h[pairs % (u + 1)]) | np.uint64(1)
        self.n_words = u + 1
        self.keys = np.concatenate([keys, both])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: occurrences in all texts, and in the target's."""
        n = len(self.keys)
        own = np.repeat(self.target, np.diff(self.at))
        tell = lambda pick: np.concatenate([np.bincount(self.now[pick], minlength=self.n_words), np.bincount(self.pair[pick], minlength=n - self.n_words)])
        return tell(slice(None)), tell(own)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: how often its text holds the pair, the word, and the word before."""
        row = np.repeat(np.arange(len(self.size)), np.diff(self.at))
        again = lambda code, n: (lambda inverse, count: count[inverse])(*np.unique(row * np.int64(n) + code, return_inverse=True, return_counts=True)[1:])
        pair, word = again(self.pair, len(self.keys)), again(self.now, self.n_words)
        context = np.roll(word, 1)
        context[self.first] = 1
        return pair, word, context


def slices(keys: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys cut to ``bits`` bits in order (the lowest bit kept: words and pairs stay apart), their places, and the slices' bounds in them."""
    keys = keys >> np.uint64(64 - bits) & ~np.uint64(1) | keys & np.uint64(1)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.array([-(-(s << bits) // parts) for s in range(1, parts)], np.uint64)
    return keys, order, np.concatenate([[0], np.searchsorted(keys, edge, "left"), [len(keys)]])


def mark_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target): target if every label of the document says good and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("target")).filter("target and doc_id is not null")
    good = durable.save(good.select(F.col("doc_id").cast("long").alias("doc_id")), "target-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if good.count() > MOST_BROADCAST:
        return rows.join(good.withColumn("target", F.lit(True)), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    ids = docs.sparkSession.sparkContext.broadcast(np.sort(good.toArrow().column(0).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids.value
        for b in batches:
            k = pc.fill_null(b.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
            found = (known[at] == k) & pc.is_valid(b.column("doc_id")).to_numpy(zero_copy_only=False) if len(known) else np.zeros(len(k), bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(found)], names=["doc_id", "text", "target"])

    return rows.mapInArrow(run, "doc_id long, text string, target boolean")


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk."""
    number = TaskContext.get().partitionId() << 32
    for b in words.chunks(batches, most=CHUNK_BYTES):
        texts = pc.fill_null(pc.utf8_lower(b.column("text")), "").cast(pa.binary())
        raw = b"".join(texts.to_pylist())
        ids = b.column("doc_id")
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flag = pc.fill_null(b.column("target"), False).to_numpy(zero_copy_only=False)
        data = pack(pc.binary_length(texts).to_numpy(zero_copy_only=False), flag.astype(np.uint8), known.astype(np.uint8), key.view(np.uint64))
        data = struct.pack("<QQ", len(data), len(raw)) + data + pa.compress(raw, "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["chunk", "data"])
        number += 1


def _loaded(data: bytes) -> tuple[Chunk, np.ndarray, np.ndarray]:
    head, length = struct.unpack_from("<QQ", data)
    size, flag, known, key = unpack(data[16 : 16 + head])
    raw = pa.decompress(data[16 + head :], length, "zstd") if length else pa.py_buffer(b"")
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype("<i8"))
    flat, at = words.split(pa.LargeStringArray.from_buffers(len(size), offsets, raw))
    code, distinct = words.encode(flat)
    return Chunk(words.hashes(distinct), code, np.diff(at), flag), known.astype(bool), key.view(np.int64)


def _ask(batches: Iterator[pa.RecordBatch], bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, data in zip(b.column("chunk").to_pylist(), b.column("data")):
            chunk, _, _ = _loaded(data.as_py())
            keys, order, bound = slices(chunk.keys, bits, parts)
            n_all, n_target = (n[order] for n in chunk.counts())
            full = np.flatnonzero(np.diff(bound))
            data = [pack(keys[a : a + 1], np.diff(keys[a:z])) + pack_counts(n_all[a:z]) + pack_counts(n_target[a:z]) for a, z in zip(bound[full], bound[full + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), number), pa.int64()), pa.array(data, pa.binary())], names=["slice", "chunk", "data"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by slice; each slice is added up and answered at its end."""
    names = [c.split()[0] for c in ANSWERED.split(", ")]

    def done(part: int, chunks: list[int], held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        size = [len(p[1]) + 1 for p in held]
        keys = np.concatenate([np.cumsum(np.concatenate(p[:2]), dtype=np.uint64) for p in held])
        distinct, at = np.unique(keys, return_inverse=True)
        total = [np.bincount(at, np.concatenate([unpack_counts(p[k : k + 3]) for p in held]), len(distinct)).astype(np.int64) for k in (2, 5)]
        word = distinct & np.uint64(1) == 0
        bound = np.concatenate([[0], np.cumsum(size)])
        sums = [int(word.sum()), *(int(t[word].sum()) for t in total)]
        for k, c in enumerate(chunks):
            own = at[bound[k] : bound[k + 1]]
            row = [c, part, b"".join(pack_counts(t[own]) for t in total), *(sums if k == 0 else (0, 0, 0))]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    part, chunks, held = -1, [], []
    for b in batches:
        for s, c, d in zip(b.column("slice").to_pylist(), b.column("chunk").to_pylist(), b.column("data")):
            if s != part and held:
                yield from done(part, chunks, held)
                chunks, held = [], []
            part = s
            chunks.append(c)
            held.append(unpack(d.as_py()))
    if held:
        yield from done(part, chunks, held)


def losses(chunk: Chunk, total: tuple[np.ndarray, np.ndarray], n_words: int, n_all: int, n_target: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss of each text under the target and the background model, its own counts left out."""
    own = chunk.own()
    row = np.repeat(np.arange(len(chunk.size)), np.diff(chunk.at))
    length = np.diff(chunk.at)
    out = []
    for n, whole, seen in ((total[1], n_target, chunk.target[row]), (total[0], n_all, np.ones(len(row), bool))):
        pair, word, context = (n[k] - np.where(seen, o, 0) for k, o in zip((chunk.n_words + chunk.pair, chunk.now, chunk.before), own))
        rest = whole - np.where(seen, length[row], 0)
        one = word / np.maximum(rest, 1)
        p = np.where(context > 0, MIX[0] * pair / np.maximum(context, 1) + MIX[1] * one, (MIX[0] + MIX[1]) * one) + MIX[2] / (n_words + 1)
        p = np.where(rest > 0, p, 1 / (n_words + 1))
        out.append(words.per_row(-np.log(p), chunk.at) / np.maximum(length, 1))
    return out[0], out[1]


def _score(batches: Iterator[pa.RecordBatch], bits: int, parts: int, sums: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Rows come by chunk, its codes first and then its answers by slice."""
    names = [c.split()[0] for c in SCORED.split(", ")]

    def done(data: bytes, answers: list[bytes]) -> pa.RecordBatch:
        chunk, known, ids = _loaded(data)
        _, order, _ = slices(chunk.keys, bits, parts)
        total = []
        for k in (0, 3):
            t = np.zeros(len(order), np.int64)
            t[order] = np.concatenate([np.zeros(0, np.int64), *[unpack_counts(unpack(a)[k : k + 3]) for a in answers]])
            total.append(t)
        target, back = losses(chunk, (total[0], total[1]), *sums)
        none = chunk.size == 0
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(chunk.size), *[pa.array(x, mask=none) for x in (target, back, target - back)]], names=names)

    data, answers = None, []
    for b in batches:
        for s, d in zip(b.column("slice").to_pylist(), b.column("data")):
            if s < 0:
                if data is not None:
                    yield done(data, answers)
                data, answers = d.as_py(), []
            else:
                answers.append(d.as_py())
    if data is not None:
        yield done(data, answers)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, both losses and the score of every row.

    A text without words (or a null one) has zero tokens, null losses and a null
    score. Repeated rows are texts of their own: each is scored by models that hold the others. A document with
    several labels is in the target if all are good; null labels count as not good, null ids match
    no label. Without any target document its model is uniform. An empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    marked = mark_target(docs, labels)
    coded = durable.save(marked.mapInArrow(_code, CODED), "coded")
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, bits = max(1, -(-n // SLICE_BYTES)), min(64, n.bit_length() + 24)
    asked = coded.mapInArrow(lambda it: _ask(it, bits, parts), ASKED)
    answers = asked.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_answer, ANSWERED)
    answers = durable.save(answers, "answers")
    sums = tuple(int(x or 0) for x in answers.agg(F.sum("n_words"), F.sum("n_all"), F.sum("n_target")).first())
    both = coded.select("chunk", F.lit(-1).alias("slice"), "data").union(answers.select("chunk", "slice", "data"))
    met = both.repartition(max(parts, spark.sparkContext.defaultParallelism), "chunk").sortWithinPartitions("chunk", "slice")
    return met.mapInArrow(lambda it: _score(it, bits, parts, sums), SCORED)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score (to six decimals) of every document; odd rows as in ``score``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels).select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


def _loss(model: str, own: str) -> str:
    """SQL of one word's loss; model is a prefix of the counts, own a condition for leaving the text's counts out."""
    less = lambda n: f"CASE WHEN {own} THEN {n} ELSE 0 END"
    pair, one = f"({model}2 - {less('o2')})", f"({model}1 - {less('o1')})"
    context, rest = f"({model}c - {less('oc')})", f"({model}n - {less('e')})"
    word = f"{one}::DOUBLE / greatest({rest}, 1)"
    p = f"CASE WHEN {context} > 0 THEN {MIX[0]}::DOUBLE * {pair} / {context} + {MIX[1]}::DOUBLE * {word} ELSE {MIX[0] + MIX[1]}::DOUBLE * {word} END + {MIX[2]}::DOUBLE / (v + 1)"
    return f"-ln(CASE WHEN {rest} > 0 THEN {p} ELSE 1.0::DOUBLE / (v + 1) END)"


SQL = f"""
WITH good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(CAST(coalesce(quality = 1 AND toxic = 0, false) AS INT)) = 1
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+'), []) AS w FROM documents
), t AS (
  SELECT r, len(w) + 1 AS e, list_append(w, ' ') AS w, d.doc_id IN (SELECT doc_id FROM good) AS good FROM d WHERE len(w) > 0
), x AS (
  SELECT r, e, coalesce(good, false) AS good, w[i] AS now, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS bef FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM t)
), g AS (
  SELECT r, e, good, bef, now, count(*) AS n FROM x GROUP BY ALL
), g1 AS (
  SELECT r, good, now AS s, sum(n) AS n FROM g GROUP BY ALL
), two AS (
  SELECT bef, now, sum(n) AS b2, sum(CASE WHEN good THEN n ELSE 0 END) AS t2 FROM g GROUP BY bef, now
), one AS (
  SELECT s, sum(n) AS b1, sum(CASE WHEN good THEN n ELSE 0 END) AS t1 FROM g1 GROUP BY s
), whole AS (
  SELECT sum(b1) AS bn, sum(t1) AS tn, count(*) AS v FROM one
), l AS (
  SELECT g.r, g.n, g.e, g.n AS o2, w1.n AS o1, c1.n AS oc, g.good, two.b2, two.t2, one.b1, one.t1, con.b1 AS bc, con.t1 AS tc, bn, tn, v
  FROM g JOIN two USING (bef, now) JOIN one ON one.s = g.now JOIN one con ON con.s = g.bef JOIN g1 w1 ON w1.r = g.r AND w1.s = g.now JOIN g1 c1 ON c1.r = g.r AND c1.s = g.bef, whole
), m AS (
  SELECT r, sum(n * ({_loss('t', 'good')})) / any_value(e) AS lt, sum(n * ({_loss('b', 'true')})) / any_value(e) AS lb FROM l GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(lt, 6) AS loss_target, round(lb, 6) AS loss_background, round(lt - lb, 6) AS score FROM d LEFT JOIN m USING (r)
"""
