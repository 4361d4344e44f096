import duckdb
import numpy as np
from pyspark.sql import functions as F

from omniframe.llm import url_filter

LABELS = "doc_id long, quality int, toxic int"


def test_hosts_without_labels_take_their_domain_s_prior(spark):
    urls = [f"http://h{k % 4}.bad.com/{k}" for k in range(400)] + [f"http://h{k % 4}.fine.com/{k}" for k in range(400)]
    urls += ["http://new.bad.com/", "http://new.fine.com/", "http://a.lone.com/", "http://b.other.info/", "http://me:pw@new.bad.com:8080/", "http://new.bad.com.:/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 400), 0) for k in range(800)], LABELS)
    got = {r.page_id: (r.host, r.verdict, r.n_host, r.bad_host) for r in url_filter.judge(pages, labels).collect()}
    assert [got[k] for k in range(800, 806)] == [
        ("new.bad.com", "block", 0, 0), ("new.fine.com", "allow", 0, 0), ("a.lone.com", "allow", 0, 0), ("b.other.info", "allow", 0, 0),
        ("me:pw@new.bad.com:8080", "block", 0, 0), ("new.bad.com.:", "block", 0, 0),
    ]
    assert got[0][1:] == ("block", 100, 100) and got[400][1:] == ("allow", 100, 0)


def test_prior_weight_follows_the_spread(spark):
    rng = np.random.default_rng(3)

    def weight(m):
        rows = []
        for d in range(60):
            mean = rng.beta(2, 3)
            for h in range(20):
                n = int(rng.integers(5, 60))
                rows.append((f"h{h}.d{d}.com", f"d{d}.com", n, int(rng.binomial(n, rng.beta(mean * m, (1 - mean) * m)))))
        h = spark.createDataFrame(rows, "site string, domain string, n_host long, bad_host long")
        return url_filter.strength(h.groupBy("domain").agg(*url_filter.sums("n_host", "bad_host")))

    for m in (3, 12, 60):
        assert 0.7 * m < weight(m) < 1.4 * m
    same = spark.createDataFrame([("d", "h", 50, 25)] * 9, "domain string, site string, n_host long, bad_host long")
    assert url_filter.strength(same.groupBy("domain").agg(*url_filter.sums("n_host", "bad_host"))) == url_filter.MOST_PRIOR
    assert url_filter.strength(same.limit(1).groupBy("domain").agg(*url_filter.sums("n_host", "bad_host"))) == url_filter.PRIOR


def test_parts_of_hosts(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("com", "y.com"), "com": ("com", "com"), "": ("", ""),
        "a.b.com.br": ("com.br", "b.com.br"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "a.co.info": ("info", "co.info"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").withColumn("s", url_filter.suffix(F.col("h")))
    assert {r.h: (r.s, r.d) for r in df.withColumn("d", url_filter.domain(F.col("h"), F.col("s"))).collect()} == want


def test_sql_on_odd_tables(spark, monkeypatch):
    """Few labels over many hosts, repeated labels and pages, a long url; the same rows as the query's SQL, broadcast or not."""
    rng = np.random.default_rng(8)
    urls = [f"http://{'u@' if k % 50 == 0 else ''}h{rng.integers(9)}.d{rng.integers(30)}.{rng.choice(['com', 'co.uk', 'info', 'de'])}{':80' if k % 40 == 0 else ''}/{k}" for k in range(1500)]
    rows = [*enumerate(urls), (3, urls[3]), (None, urls[4]), (1600, None), (1601, ""), (1602, "http://h1.d1.com/" + "x" * 300_000), (1603, "http://9.9.9.9/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(int(k), int(rng.random() > (k % 30) / 30), 0) for k in rng.integers(0, 1500, 500)] + [(7, None, 1), (8, None, None), (None, 0, 0)], LABELS)
    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        con.register(name, df.toArrow())
    want = sorted(con.sql(url_filter.SQL).fetchall(), key=str)
    for most in (url_filter.MOST_BROADCAST, 0):
        monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
        assert sorted(map(tuple, url_filter.judge(pages, labels).collect()), key=str) == want
    assert {r[4] for r in want} == {"allow", "block"}
