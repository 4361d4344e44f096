import hashlib
import random
import re
from collections import Counter

from omniframe.llm import substrings


def brute(rows, width):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, rows, width):
    got = substrings.dedup(docs(rows), width).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_random_texts(docs):
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(120):
        w = [f"{k}-{rnd.randrange(4000)}" for _ in range(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(0, 3)):
            a = rnd.randrange(0, 40)
            at = rnd.randrange(0, len(w) + 1)
            w[at:at] = passage[a : a + rnd.randrange(5, 60)]
        rows.append((k, rnd.choice([" ", "\n", " \t"]).join(w)))
    check(docs, rows, 35)
    check(docs, rows, 5)


def test_odd_rows(docs):
    run = "a b " * 40
    rows = [(1, None), (2, ""), (3, run), (4, "x y z"), (4, "x y z"), (None, "q " * 30), (None, "q " * 50), (5, " ".join(map(str, range(35)))), (6, " ".join(map(str, range(35)))), (6, " ".join(map(str, range(35))))]
    check(docs, rows, 35)
    assert substrings.dedup(docs([])).count() == 0


def test_the_sketch_never_counts_too_few():
    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"{(i * 7 + j) % 97}" for j in range(200)) for i in range(30)]
    h, at, _ = substrings._hashes(pa.array(texts))
    where, anchor, placed = substrings.anchors(h, at, 35)
    windows = Counter(bytes(h[w : w + 35]) for w in where)
    seen = Counter(placed.tolist())
    assert all(seen[a] >= windows[bytes(h[w : w + 35])] for w, a in zip(where.tolist(), anchor.tolist()))
    assert len(placed) < len(where) / 5
    assert np.isin(anchor, placed).all()


def test_a_very_long_text(docs):
    words = [f"w{k * 7919 % 100_003}" for k in range(90_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[50_000:50_050])), (3, " ".join(["again"] * 20_000)), (None, " ".join(words[:34]))]
    check(docs, rows, 35)
