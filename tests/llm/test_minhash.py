import random

import numpy as np
import pyarrow as pa

from omniframe.llm import minhash, simhash

RND = random.Random(3)


def prose(n):
    return [f"w{RND.randrange(5000)}" for _ in range(n)]


def edited(w, n):
    w = list(w)
    for i in RND.sample(range(len(w)), n):
        w[i] = f"x{RND.randrange(10**6)}"
    return w


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def survivors(rows):
    """Smallest id of each component of all pairs with an overlap of 0.8 or more."""
    sets = {k: grams(t) for k, t in rows}
    label = {k: k for k in sets}
    near = {a: [b for b in sets if a == b or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in sets}
    while (new := {a: min(label[b] for b in near[a]) for a in sets}) != label:
        label = new
    return {*label.values()}


def test_keep_one_against_all_pairs(docs):
    rows, exact = [], 0
    for _ in range(12):
        w = prose(RND.choice([12, 60, 200, 900]))
        rows += [(len(rows), " ".join(w))]
        for n in (0, 1, 1, 2, 4, 8, 12):
            if n < len(w):
                rows += [(len(rows), " ".join(edited(w, n)).upper() if n else " ".join(w))]
        # a chain: each near the one before, the ends not near each other
        for _ in range(4):
            w = edited(w, max(1, len(w) // 60))
            rows += [(len(rows), " ".join(w))]
    rows += [(len(rows), "one two"), (len(rows) + 1, "one two"), (len(rows) + 2, "one three")]
    want = survivors(rows)
    got = {r.doc_id for r in simhash.keep_one(docs(rows)).collect()}
    assert got == want and len(want) < len(rows) - 40


def test_pairs_that_miss_the_smallest_member(docs):
    # all texts in one bucket: those that are not near the bucket's smallest are still compared
    old = minhash.sketch
    base = [prose(100) for _ in range(4)]
    rows = [(10 * i + j, " ".join(edited(w, j))) for i, w in enumerate(base) for j in range(3)]
    want = survivors(rows)

    def one(texts):
        node, size, keys, minima = old(texts)
        return node, size, keys * 0 + np.arange(minhash.BANDS, dtype=np.uint64), minima

    try:
        minhash.sketch = one
        docs_ = docs(rows)
        run = minhash.sketches(docs_.selectExpr("doc_id", "text"), "doc_id").collect()
        assert len({tuple(r.bands) for r in run}) == 1
        assert {r.doc_id for r in simhash.keep_one(docs_).collect()} == want
    finally:
        minhash.sketch = old


def test_fingerprints_link_close_copies_first(docs, monkeypatch):
    # no two texts share a band: close copies are still found, by their fingerprints, and verified on the texts
    old, copies = minhash.sketch, []
    while len(copies) < 6:
        w = prose(900)
        three = [" ".join(w + ["end"] * j) for j in range(3)]
        prints = simhash.simhash(pa.array(three), minhash.WIDTH)
        if (np.bitwise_count(prints ^ prints[0]) <= 2).all():
            copies.append(three)
    rows = [(10 * i + j, t) for i, three in enumerate(copies) for j, t in enumerate(three)]
    rows += [(100, "one two"), (101, "one  Two"), (102, "")]

    def alone(texts):
        node, size, keys, minima = old(texts)
        return node, size, (node[:, None] + np.arange(minhash.BANDS, dtype=np.uint64)), minima

    monkeypatch.setattr(minhash, "sketch", alone)
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == survivors(rows) == {*range(0, 60, 10), 100, 102}


def test_parities_never_lose_a_pair():
    """Bits differ in no more places than shingles differ, so the bound on near pairs is never broken."""
    texts, grams_ = [], []
    for _ in range(40):
        w = prose(RND.choice([3, 20, 200, 3000]))
        for n in (0, 1, 3, 15):
            texts.append(" ".join(edited(w, min(n, len(w)))))
            grams_.append(grams(texts[-1]))
    bits = minhash.parities(pa.array(texts)).view(np.uint64)
    for i in range(len(texts)):
        for j in range(i - i % 4, i):
            both = len(grams_[i] & grams_[j])
            differ, total = int(np.bitwise_count(bits[i] ^ bits[j]).sum()), len(grams_[i]) + len(grams_[j])
            assert differ <= total - 2 * both
            assert both < minhash.LEAST * (total - both) or differ * (1 + minhash.LEAST) <= total * (1 - minhash.LEAST) + 1e-6
