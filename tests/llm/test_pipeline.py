"""The pipeline's stages on a small table whose right rows are known."""

import random

import corpus_pipeline
from omniframe.llm import quality, token_store

RND = random.Random(9)


def prose(n):
    return " ".join("".join(RND.choice("abcdefghij") for _ in range(RND.randrange(2, 9))) for _ in range(n))


def test_stages(spark, docs, tmp_path):
    good = {k: prose(80) for k in range(40)}
    rows = [(k, t, "en", f"s{k % 4}") for k, t in good.items()]
    item = prose(30)
    rows += [(100, good[3], "en", "s1"), (101, "junk", "en", "s2"), (102, prose(30) + " " + item + " " + prose(20), "en", "s0"), (103, None, None, None)]
    docs(rows).drop("key", "h").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, now = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns = now.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        assert name == "token_ids" or out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append([r.doc_id for r in now.collect()])
    assert sorted(seen[0]) == [*range(40), 100, 102]
    assert sorted(seen[1]) == [*range(40), 102]
    assert sorted(seen[2]) == [*range(40)]
    assert set(seen[3]) <= set(range(40)) and sorted(seen[3]) == sorted(seen[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(seen[4])
    assert quality.MOST_LABELLED and token_store.MAGIC


def test_empty_and_null_rows(spark, docs, tmp_path):
    for k, rows in enumerate(([], [(None, None, None, None), (None, prose(60), None, None), (5, "", "en", "s"), (None, None, None, None)])):
        sf = f"file://{tmp_path}/{k}"
        docs(rows).drop("key", "h").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert all(r.doc_id is None and r.n_tokens > 60 for r in got) and len(got) == (k and 1)
