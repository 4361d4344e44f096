"""Every registered query that SQL can express, against DuckDB."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from omniframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(shown(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark):
    from omniframe.engine import star

    plan = star(spark, SF).value("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "EqualNullSafe(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_links_read_only_their_columns(spark):
    from omniframe.engine import star

    plan = star(spark, SF).value("EXPLAIN SELECT o_custkey.c_name AS n FROM orders")
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_split_words_of_odd_texts(spark, tmp_path):
    texts = [None, "", " ", "\n", "\t\r\n", "a b", "a\x0bb", "\x0b", "\x0ca\x0cb", "a\rb", "a\u00a0b", "a\u0085b", "a\u3000b", "a\x1cb", "a\x00b", "A a", "  b  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.w, r.n) for r in queries.QUERIES["split_words"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.sql(queries.ORACLE["split_words"]).fetchall())
