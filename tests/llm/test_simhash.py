import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from omniframe.llm import components as components_module
from omniframe.llm import simhash
from omniframe.llm.components import components


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def test_fingerprints():
    texts = ["", None, "One", "one two", "A b c d e f", "É é\x0bx\u00a0y z", " \t\n", "w " * 500, "the THE the the the", "a\x1cb c d"]
    assert simhash.simhash(pa.array(texts, pa.string())).tolist() == [brute(t) for t in texts]


def grouped(prints):
    """Smallest key of everything within reach by steps of two bits or fewer."""
    keys = sorted(prints)
    label = {k: k for k in keys}
    while True:
        new = {k: min(label[o] for o in keys if (prints[k] ^ prints[o]).bit_count() <= 2) for k in keys}
        if new == label:
            return label
        label = new


def test_groups_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    prints, n = {}, 0
    for centre in rng.integers(0, 1 << 63, 12):
        for _ in range(int(rng.integers(1, 60))):  # crowded keys, chains and lone ones
            p = int(centre)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                p ^= 1 << int(b)
            prints[n] = p
            n += 1
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in prints.items()]
    df = spark.createDataFrame(signed, "key long, fp long")
    named = df.join(simhash.near_groups(df), "fp").collect()
    assert {r.key: r.component_id for r in named} == grouped(prints)


@pytest.mark.parametrize("share", [1_000_000, 7])
def test_components_of_a_long_chain(spark, monkeypatch, share):
    monkeypatch.setattr(components_module, "LOCAL_EDGES", share)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_with_nothing_in_them(docs):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, "x y z"), (4, "x y z"), (5, long), (6, long + " tail"), (None, "x y z"), (3, "x y z")]
    got = simhash.assign(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == "0" * 16
    assert by[2][0].component_id == 1 and by[4][0].component_id == 3 and by[None][0].component_id == 3
    assert by[6][0].component_id == 5
    assert simhash.assign(docs([])).count() == 0


def test_keep_one(docs):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(9, long), (4, long + " end"), (5, "alone here now"), (5, "alone here now"), (None, None), (7, None), (None, "only null")]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(False, 4, "w0 w1"), (False, 5, "alone"), (False, 7, ""), (True, 0, "only ")]
    assert simhash.keep_one(docs([])).count() == 0


def test_keep_one_with_clashing_names(docs):
    long = " ".join(f"w{i}" for i in range(300))
    names = ["_k1", "_k2", "_n", "k1", "k2", "row", "node", "root", "r", "size", "bands"]
    odd = docs([(1, long), (2, long), (3, None), (4, ""), (5, "other words stand here now")]).selectExpr("*", *[f"doc_id AS {n}" for n in names])
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 5]


def test_crowded_fingerprints_by_broadcast(docs, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)
    rows = [(k, "the same words here" if k % 2 else f"text {k} alone in this") for k in range(40)] + [(None, "the same words here"), (50, None), (51, "")]
    got = {r.doc_id: r.component_id for r in simhash.assign(docs(rows)).collect()}
    assert len(got) == 43 and got[None] == got[39] == 1 and got[51] == got[50] == 50
    assert all(got[k] == grouped({j: brute(t) for j, t in rows if j is not None})[k] for k in range(0, 40, 2))
