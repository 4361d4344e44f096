from collections import Counter

from pyspark.sql import functions as F

from omniframe.llm import mixing


def filled(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    left, full = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 1, None: 40, "é": 7}, {"x": 9}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1000, "d": 2}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got.keys() == sizes.keys()
        for s, t in filled(sizes).items():
            assert abs(got[s] - t) < 1e-9 * max(1, t), (sizes, s, got[s], t)
    assert mixing.targets(spark.createDataFrame([], "source string, size long")).count() == 0


def test_copies(docs):
    rows = [(k, "w " * (1 + k % 7), "en", "big" if k % 3 else "small") for k in range(600)] + [(None, None, "en", None), (1000, "", "en", "none"), (1000, "", "en", "none")]
    out = mixing.mix(docs(rows))
    assert out.columns == docs([]).columns
    again = Counter(map(tuple, mixing.mix(docs(rows)).collect()))
    got = Counter(map(tuple, out.collect()))
    assert got == again and max(got.values()) <= 3
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = filled(dict(sizes))
    for s in ("big", "small"):
        taken = sum(n * size(r[1]) for r, n in got.items() if r[3] == s)
        assert abs(taken - want[s]) < 0.2 * want[s]
    assert mixing.mix(docs([])).count() == 0


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc ",), ("a\u00a0b",), ("\x1cx",)], "text string")
    assert [r.n for r in df.select(mixing.n_words(F.col("text")).alias("n")).collect()] == [0, 0, 3, 1, 1]


def test_clashing_names(docs):
    rows = [(k, "w " * (1 + k % 7), "en", "big" if k % 3 else "small") for k in range(60)]
    plain = Counter(r.doc_id for r in mixing.mix(docs(rows)).collect())
    names = ["_n", "_s", "_t", "_c", "row", "size", "source_size", "target", "time", "_1"]
    odd = docs(rows).selectExpr("*", *[f"doc_id AS {n}" for n in names])
    out = mixing.mix(odd)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == plain
    assert all(r.doc_id == r["_c"] == r["time"] for r in out.collect())


def test_very_long_text(docs):
    rows = [(1, "word " * 400_000, "en", "a"), (2, "x", "en", "b")]
    assert mixing.mix(docs(rows)).count() >= 1
