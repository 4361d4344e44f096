"""Decontamination against a plain aligner that goes through all diagonals."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from omniframe.llm import decontaminate as D

RND = random.Random(23)


def words_of(t):
    return re.sub(r"[^\w]|_", " ", (t or "").lower()).split()


def best_stretch(same, need):
    """The longest stretch of all, found by going through them; stripped of replaced words at its ends."""
    n = len(same)
    for size in range(n, need - 1, -1):
        for a in range(n - size + 1):
            if 5 * sum(same[a : a + size]) >= 4 * size:
                z = a + size
                while not same[a]:
                    a += 1
                while not same[z - 1]:
                    z -= 1
                return a, z
    return None


def brute(docs, items):
    out = []
    for k, t in docs:
        w = words_of(t)
        for i, u in items:
            v, best = words_of(u), None
            need = min(13, len(v))
            for d in range(1 - len(v), len(w)) if v else ():
                lo, hi = max(0, -d), min(len(v), len(w) - d)
                got = best_stretch([v[q] == w[q + d] for q in range(lo, hi)], need) if hi - lo >= need else None
                if got:
                    a, z = got[0] + lo, got[1] + lo
                    rank = (z - a, sum(v[q] == w[q + d] for q in range(a, z)), -(a + d), -a)
                    best = rank if best is None or rank > best else best
            if best:
                out.append((k, i, best[1], best[0], -best[2], -best[3]))
    return sorted(out, key=str)


def test_masks_lose_nothing():
    """Every way to replace a fifth of a piece's words leaves a seed whole; the pieces are those that longer ones reduce to."""

    def whole(mask, gone, n):
        return any(not any(mask[g - s] == "1" for g in gone if s <= g < s + len(mask)) for s in range(n - len(mask) + 1))

    for n, k in ((13, 2), (15, 3), (20, 4)):
        assert all(any(whole(m, c, n) for m in D.MASKS) for c in itertools.combinations(range(n), k)), (n, k)
    bits = [(int(m[::-1], 2), len(m)) for m in D.MASKS]
    lost = [c for c in itertools.combinations(range(25), 5) if not any((sum(1 << i for i in c) & (m << s)) == 0 for m, size in bits for s in range(26 - size))]
    assert not lost
    for n in range(1, 13):
        m = len(D.short_mask(n))
        assert all(any(not any(s <= g < s + m for g in c) for s in range(n - m + 1)) for c in itertools.combinations(range(n), n // 5)), n


def corrupted(w, n):
    w = list(w)
    for i in RND.sample(range(len(w)), n):
        w[i] = f"x{RND.randrange(10**6)}"
    return w


def rows_and_items():
    noise = lambda n: [f"n{RND.randrange(400)}" for _ in range(n)]
    items, rows = [], []
    for k in range(40):
        w = [f"i{RND.randrange(300)}" for _ in range(RND.choice([1, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 31, 60]))]
        items.append((k, " ".join(w)))
        for _ in range(4):
            part = w if RND.random() < 0.7 else w[RND.randrange(len(w)) :]
            part = corrupted(part, min(len(part), RND.choice([0, len(part) // 5, len(part) // 5 + 1, len(part) // 4])))
            rows.append((len(rows), " ".join(noise(RND.randrange(15)) + part + noise(RND.randrange(15)))))
    return rows, items


def test_against_all_diagonals(spark, docs):
    rows, items = rows_and_items()
    rows += [(900, None), (901, ""), (902, "a b " * 30), (0, rows[0][1]), (None, items[5][1].upper().replace(" ", ", ")), (903, "same " * 60), (904, " ".join(f"w{i}" for i in range(20_000)) + " " + items[12][1])]
    items += [(100, None), (101, ""), (102, "same " * 40), (103, "a b " * 10), (102, "same " * 40), (None, "b a b a b a")]
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string")
    plain = [r for r in rows if r[0] != 904]
    got = sorted(map(tuple, D.overlaps(docs(rows), bench).collect()), key=str)
    assert [g for g in got if g[0] != 904] == brute(plain, items)
    assert len({g[:2] for g in got}) > 100 and [g[:2] for g in got if g[0] == 904][-1:]
    left = D.drop_leaks(docs(rows).selectExpr("*", "1 AS _k", "2 AS text_a"), bench)
    hit = {g[0] for g in got}
    assert left.columns == [*docs([]).columns, "_k", "text_a"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, _ in rows if k not in hit)
    assert D.overlaps(docs([]), bench).count() == D.overlaps(docs(rows), bench.limit(0)).count() == 0
    assert D.drop_leaks(docs([]), bench).count() == 0


@pytest.mark.parametrize("n,k", [(12, 2), (13, 2), (14, 2), (15, 3), (16, 3), (20, 4), (33, 6)])
def test_no_overlap_is_missed(n, k):
    items = [[f"i{j}w{i}" for i in range(n)] for j in range(200)]
    h = [D.word_hashes(pa.array([" ".join(w)]))[0] for w in items]
    block = D.Block([*range(200)], [0] * 200, h)
    texts = pa.array([" ".join(corrupted(w, k)) for w in items])
    assert {(j, j) for j in range(200)} <= block.overlaps(*D.word_hashes(texts)).keys()


def test_pieces_of_a_long_item(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    w = [f"w{i}" for i in range(300)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "short one here")], "item_id long, text string")
    rows = [(a, " ".join(w[a : a + 13])) for a in range(288)] + [(999, "short one here")]
    got = D.overlaps(docs(rows), bench).collect()
    assert {r.doc_id for r in got} == {*range(288), 999} and all(r.item_start == r.doc_id for r in got if r.item_id == 1 and r.n_overlap == 13)
    assert D.drop_leaks(docs(rows), bench).count() == 0


def test_repeated_words_stay_cheap():
    h = [np.full(40, 7, np.uint64) for _ in range(40)]
    began = time.time()
    got = D.Block([*range(40)], [0] * 40, h).overlaps(np.full(20_000, 7, np.uint64), np.array([0, 20_000]))
    assert len(got) == 40 and {*got.values()} == {(40, 40, 0, 0)} and time.time() - began < 30
