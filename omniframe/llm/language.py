"""Operator 7: language of every word, and so of every text, by a linear-chain CRF.

Each word is a node; its features are its hashed byte n-grams of two to four bytes,
where marks of the word's ends count as bytes (those with a mark are the affixes),
the word itself, and its entry in a lexicon: for each language, how large its
share is among the occurrences of the word in the labelled texts. Transitions between neighbouring words'
languages are learned with them. Forward-backward gives each word's
probabilities, so code-switched text gets its words labelled one by one; a text's
language is the one with the highest mean probability over its words with a
letter, and the score is that mean.

The CRF is fitted on whole texts of at most ``MOST_DOCS`` labelled documents, chosen by a hash
of their id, as many as ``MOST_BYTES`` hold. They are cut into stretches of ``SPAN`` words, all of
which are used; every third stretch is joined with one of another document, so that changes of language are seen too.
Whole texts are labelled, in Arrow batches; all texts of a batch step
through the recursions together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import durable, words

MOST_DOCS = 2000
#: Bytes of labelled text that reach the driver.
MOST_BYTES = 2 << 20
SPAN = 60
#: A word is in the lexicon from so many occurrences on; its shares are told in so many steps.
LEAST_SEEN, STEPS = 3, 3
BITS = 17
EPOCHS = 12
RATE = 0.3
TAGGED = "doc_id long, held_out boolean, lang_pred string, score double"


def word_features(distinct: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all distinct words in order, and each word's offsets in them."""
    n = len(distinct)
    names = pc.ascii_lower(distinct.cast(pa.string())).cast(pa.binary()).to_pylist()
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in names), np.uint8).astype(np.uint32)
    length = np.fromiter((len(w) + 2 for w in names), np.int64, n)
    owner = np.repeat(np.arange(n), length)
    own, value = [np.arange(n)], [(words.hashes(pa.array(names, pa.binary()), 7) >> np.uint64(64 - BITS)).astype(np.int64)]
    shift = np.uint32(32 - BITS)
    for width in (2, 3, 4):
        k = len(raw) - width + 1
        if k <= 0:
            continue
        inside = owner[:k] == owner[width - 1 :]
        x = np.full(k, width, np.uint32)
        for j in range(width):
            x = (x ^ raw[j : k + j]) * np.uint32(2654435761)
            x ^= x >> np.uint32(13)
        own.append(owner[:k][inside])
        value.append((x[inside] >> shift).astype(np.int64))
    entry, place = lexicon.features(distinct)
    o = np.concatenate([*own, entry])
    order = np.argsort(o, kind="stable")
    return np.concatenate([*value, place])[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n))])


@dataclass
class Lexicon:
    """Words (their hashes, sorted) and for each language the step of its share, 0 for hardly any."""

    words: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, distinct: pa.Array, count: np.ndarray) -> Lexicon:
        """From distinct words and their occurrences by language."""
        h = words.hashes(pc.ascii_lower(distinct.cast(pa.string())), 9)
        names, at = np.unique(h, return_inverse=True)
        total = np.stack([np.bincount(at, c, len(names)) for c in count.T], axis=1)
        seen = total.sum(axis=1)
        keep = seen >= LEAST_SEEN
        share = total[keep] / seen[keep][:, None]
        return cls(names[keep], np.minimum((share * (STEPS + 1)).astype(np.int64), STEPS))

    def features(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word's number, slot) of every entry; slots follow those of the hashed features."""
        if not len(self.words) or not len(distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes(pc.ascii_lower(distinct.cast(pa.string())), 9)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = np.flatnonzero(self.words[at] == h)
        step = self.step[at[known]]
        own, lang = np.nonzero(step)
        return known[own], (1 << BITS) + lang * STEPS + step[own, lang] - 1


@dataclass
class Crf:
    langs: list[str]
    lexicon: Lexicon
    weight: np.ndarray  # slots x languages
    move: np.ndarray  # language before x language
    begin: np.ndarray

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        if not len(distinct):
            return np.zeros((0, len(self.langs)), np.float32)
        slot, at = word_features(distinct, self.lexicon)
        return np.add.reduceat(self.weight[slot], at[:-1], axis=0) / np.diff(at)[:, None] ** 0.5

    def marginals(self, emit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each word's probabilities by forward-backward over each text's words; emit is by word."""
        return forward_backward(emit, at, self.move, self.begin)[0]


def forward_backward(emit: np.ndarray, at: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's label, and expected counts of label pairs.

    Texts are sorted by length, longest first, so that those still running at a step are a prefix.
    """
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, size = at[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    score = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    jump = np.exp(move - move.max())
    ahead = np.empty_like(score)
    now = None
    for t in range(longest):
        i = first[: live[t]] + t
        now = (np.exp(begin - begin.max()) if t == 0 else now[: live[t]] @ jump) * score[i]
        now /= now.sum(axis=1, keepdims=True)
        ahead[i] = now
    out = np.empty_like(score)
    pairs = np.zeros_like(jump)
    back = np.ones((0, emit.shape[1]))
    for t in range(longest - 1, -1, -1):
        n = live[t]
        i = first[:n] + t
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), emit.shape[1]))])
        p = ahead[i] * back
        p /= p.sum(axis=1, keepdims=True)
        out[i] = p
        if t:
            b = score[i] * back
            a = ahead[i - 1]
            z = ((a @ jump) * b).sum(axis=1, keepdims=True)
            pairs += jump * ((a / z).T @ b)
            back = b @ jump.T
            back /= back.sum(axis=1, keepdims=True)
    return out, pairs


def train(rows: list[tuple[str, str]]) -> Crf | None:
    """Fit on (language, text) rows in the order given; None if there is none with a word."""
    rows = [(y, words.split(pa.array([t]))[0].to_pylist()) for y, t in rows]
    langs = sorted({y for y, w in rows if w})
    if not langs:
        return None
    rng = np.random.default_rng(7)
    parts = [(y, w[a : a + SPAN]) for y, w in rows for a in range(0, len(w), SPAN)]
    flat, label, at = [], [], [0]
    for k in range(len(parts)):
        for y, w in [parts[k]] if k % 3 else [parts[k], parts[int(rng.integers(len(parts)))]]:
            flat += w
            label += [langs.index(y)] * len(w)
        at.append(len(flat))
    code, distinct = words.encode(pa.array(flat, pa.string()))
    n, offsets, y = len(langs), np.array(at), np.array(label)
    lexicon = Lexicon.of(distinct, np.stack([np.bincount(code[y == j], minlength=len(distinct)) for j in range(n)], axis=1))
    slot, bound = word_features(distinct, lexicon)
    size = (1 << BITS) + n * STEPS
    own = np.repeat(np.arange(len(distinct)), np.diff(bound))
    model = Crf(langs, lexicon, np.zeros((size, n)), np.zeros((n, n)), np.zeros(n))
    scale = (1 / np.diff(bound) ** 0.5)[:, None]
    inner = np.ones(len(y), bool)
    inner[offsets[:-1]] = False
    p = np.flatnonzero(inner)
    true_pairs = np.zeros((n, n))
    np.add.at(true_pairs, (y[p - 1], y[p]), 1)
    true = np.eye(n)[y]
    seen_w, seen_m, seen_b = np.full((size, n), 1e-8), np.full((n, n), 1e-8), np.full(n, 1e-8)
    for _ in range(EPOCHS):
        emit = np.add.reduceat(model.weight[slot], bound[:-1], axis=0) * scale
        prob, pairs = forward_backward(emit[code], offsets, model.move, model.begin)
        miss = (prob - true) / len(y)
        by_word = np.stack([np.bincount(code, miss[:, j], minlength=len(distinct)) for j in range(n)], axis=1) * scale
        grad = np.stack([np.bincount(slot, by_word[own, j], minlength=size) for j in range(n)], axis=1) + 1e-7 * model.weight
        gm, gb = (pairs - true_pairs) / len(y) + 1e-4 * model.move, miss[offsets[:-1]].sum(axis=0)
        for x, g, seen in ((model.weight, grad, seen_w), (model.move, gm, seen_m), (model.begin, gb, seen_b)):
            seen += g * g
            x -= RATE * g / np.sqrt(seen)
    model.weight = model.weight.astype(np.float32)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, most: int = MOST_DOCS) -> list[tuple[str, str]]:
    """Whole texts of up to ``most`` labelled rows outside the held-out fifth, by a hash of the id, as many as MOST_BYTES hold.

    Only sizes are gathered first; a text that does not fit into what is left of the bound is passed over.
    """
    pool = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = words.bounded_sample(pool.select("doc_id").distinct(), F.col("doc_id"), most, ["doc_id"])
    rows = pool.filter(F.col("text").isNotNull() & (F.octet_length("text") <= MOST_BYTES)).join(F.broadcast(ids), "doc_id").select("chosen", "doc_id", "lang", "text")
    # an id may repeat; its first row by language and text stands for it
    first = durable.save(rows.groupBy("chosen", "doc_id").agg(F.min(F.struct("lang", "text")).alias("r")), "labelled")
    left, fits = MOST_BYTES, []
    for r in sorted(first.select("chosen", "doc_id", F.octet_length("r.text").alias("n")).collect()):
        if r.n <= left:
            left -= r.n
            fits.append(r.doc_id)
    got = first.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fits], "doc_id long")), "doc_id").collect()
    return [(r.r.lang, r.r.text) for r in sorted(got, key=lambda r: (r.chosen, r.doc_id))]


def label(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if nothing could be learned. Words without a letter take part in the
    chain but not in the mean. Repeated rows are labelled alike, a null id is not held out; an
    empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in words.chunks(batches):
            n = b.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            flat, at = words.split(b.column("text"))
            if m is not None and len(flat):
                code, distinct = words.encode(flat)
                p = m.marginals(m.emissions(distinct)[code], at)
                letter = pc.match_substring_regex(distinct, r"\pL").to_numpy(zero_copy_only=False)[code]
                count = words.per_row(letter.astype(np.int64), at)
                mean = np.stack([words.per_row(np.where(letter, p[:, j], 0.0), at) for j in range(len(m.langs))], axis=1) / np.maximum(count, 1)[:, None]
                some = count > 0
                pred[some] = np.array(m.langs, object)[mean.argmax(axis=1)][some]
                score[some] = np.clip(mean.max(axis=1), 0, 1)[some]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, TAGGED)


def label_words(model: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of every word of one text."""
    flat, at = words.split(pa.array([text]))
    code, distinct = words.encode(flat)
    p = model.marginals(model.emissions(distinct)[code], at)
    return [(w, model.langs[int(q.argmax())], float(q.max())) for w, q in zip(flat.to_pylist(), p)]


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; odd rows as in ``label``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label(docs, train(sample(docs)))
