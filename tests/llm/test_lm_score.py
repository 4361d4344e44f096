"""Scores against plain counting in dictionaries, and against the query's SQL."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from omniframe.llm import lm_score as L

RND = random.Random(31)
EN, DE = ["the", "and", "thing", "with", "nation", "ever", "house"], ["der", "und", "schön", "nicht", "über", "zeit", "haus"]


def text(pool, n):
    return " ".join(RND.choice(pool) for _ in range(n))


def brute(rows, good):
    texts = [(t or "").lower().split() for _, t in rows]
    seq = [["\0", *w, "\0"] if w else [] for w in texts]
    pairs = [Counter(zip(s, s[1:])) for s in seq]
    once = [Counter(s[1:]) for s in seq]
    total = {k: (sum((pairs[i] for i in pick), Counter()), sum((once[i] for i in pick), Counter())) for k, pick in (("b", range(len(rows))), ("t", [i for i, r in enumerate(rows) if r[0] in good]))}
    v = len(total["b"][1]) + 1
    out = []
    for i, (k, _) in enumerate(rows):
        if not seq[i]:
            out.append((k, 0, None, None))
            continue
        loss = {}
        for m, (two, one) in total.items():
            own = m == "b" or k in good
            n = sum(one.values()) - own * len(seq[i][1:])
            loss[m] = 0.0
            for a, b in zip(seq[i], seq[i][1:]):
                p2, c, p1 = two[a, b] - own * pairs[i][a, b], one[a] - own * once[i][a], (one[b] - own * once[i][b]) / max(n, 1)
                p = (0.55 * p2 / c + 0.4 * p1 if c else 0.95 * p1) + 0.05 / v if n else 1 / v
                loss[m] -= math.log(p) / len(seq[i][1:])
        out.append((k, len(texts[i]), loss["t"], loss["b"]))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], r[3] or 0)) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        if w[2] is not None:
            assert abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - (w[2] - w[3])) < 1e-9


@pytest.mark.parametrize("chunk,part,most", [(4 << 20, 8 << 20, 8_000_000), (400, 900, 8_000_000), (100, 1 << 20, 0)])
def test_scores_against_plain_counts(spark, docs, monkeypatch, chunk, part, most):
    monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(L, "SLICE_BYTES", part)
    monkeypatch.setattr(L, "MOST_BROADCAST", most)
    rows = [(k, text(EN if k % 2 else DE, RND.randrange(1, 60))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, " \t"), (None, text(EN, 9)), (1, text(EN, 9)), (3, rows[3][1]), (203, "once only words Here É"), (204, "a " * 700), (205, text(DE, 4000))]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(1, 1, 0), (5, 1, 1), (7, None, 0), (None, 1, 0), (200, 1, 0)], "doc_id long, quality int, toxic int")
    good = {k for k in range(80) if k % 2 and k not in (5, 7)} | {200}
    got = list(map(tuple, L.score(docs(rows), labels).collect()))
    same(got, brute(rows, good))
    by = {g[0]: g[4] for g in got}
    assert max(by[k] for k in range(9, 80, 2)) < min(by[k] for k in range(0, 80, 2) if len(rows[k][1].split()) > 5)


def test_empty_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert L.score(docs([]), labels).count() == 0
    rows = [(1, "a b"), (2, None)]
    same(list(map(tuple, L.score(docs(rows), labels.limit(0)).collect())), brute(rows, set()))


def test_packing():
    rng = np.random.default_rng(1)
    for top in (1, 200, 300, 70_000, 1 << 40):
        n = rng.integers(0, top, 50)
        assert L.unpack_counts(L.unpack(L.pack_counts(n))).tolist() == n.tolist()
    assert [x.tolist() for x in L.unpack(L.pack(np.array([], np.uint64), np.array([5, 1 << 63], np.uint64)))] == [[], [5, 1 << 63]]


def test_sql_gives_the_same_rows(spark):
    import duckdb

    got = L.op2_lm_score(spark, "/root/testdata/sf0.001").collect()
    for t in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = duckdb.sql(L.SQL).fetchall()
    key = lambda r: [-1 if x is None else x for x in r[:2]]
    assert [tuple(r) for r in sorted(got, key=key)] == sorted(want, key=key)
