import pytest
from pyspark.errors import PySparkException

from omniframe.plans.compiler import QueryError
from omniframe.plans.runner import Thrown
from omniframe.streaming import live


def test_create_update_delete(engine):
    q = engine.value
    q("CREATE p:a SET name = 'Ann', age = 30, tags = ['x']; CREATE p:b CONTENT { name: 'Bob', age: 25 }")
    assert q("UPDATE p SET age += 1, tags += 'y' WHERE name = 'Ann'")[0]["tags"] == ["x", "y"]
    assert q("SELECT VALUE age FROM p ORDER BY id") == [{"age": 31}, {"age": 25}]
    q("UPSERT p:c SET name = 'Cy'; UPDATE p:c MERGE { addr: { zip: 5 } }; UPDATE p:c UNSET name")
    assert q("SELECT addr.zip AS z, name FROM p:c") == [{"z": 5, "name": None}]
    # a missing age sorts before every number
    assert sorted(r["id"] for r in q("DELETE p WHERE age < 30 RETURN BEFORE")) == ["p:b", "p:c"]
    assert q("SELECT count() AS n FROM p GROUP ALL") == [{"n": 1}]


def test_repeated_ids(engine):
    engine.query("CREATE p:a SET v = 1")
    with pytest.raises(QueryError):
        engine.query("CREATE p:a SET v = 2")
    assert engine.value("INSERT IGNORE INTO p [{ id: 'a', v: 3 }, { id: 'b', v: 4 }]") == [{"id": "p:b", "v": 4}]
    engine.query("INSERT INTO p { id: 'a', v: 9 } ON DUPLICATE KEY UPDATE v += $input.v")
    assert engine.value("SELECT v FROM p:a") == [{"v": 10}]


def test_edges_go_with_their_records(engine):
    engine.query("CREATE p:a SET n = 1; CREATE p:b SET n = 2; CREATE p:c SET n = 3; RELATE p:a->knows->p:b; RELATE p:b->knows->p:c")
    assert engine.value("SELECT id, ->knows->p.n AS f FROM p ORDER BY id") == [{"id": "p:a", "f": [2]}, {"id": "p:b", "f": [3]}, {"id": "p:c", "f": []}]
    assert engine.value("RETURN p:a.{..+collect}(->knows->p)") == ["p:b", "p:c"]
    engine.query("DELETE p:b")
    assert engine.value("SELECT count() AS n FROM knows GROUP ALL") == [{"n": 0}]


def test_fields(engine):
    engine.query("DEFINE FIELD age ON u TYPE int ASSERT $value > 0; DEFINE FIELD made ON u DEFAULT 'now'; DEFINE FIELD low ON u VALUE string::lowercase($value)")
    assert engine.value("CREATE u:1 SET age = '5', low = 'ABC'") == [{"id": "u:1", "age": 5, "low": "abc", "made": "now"}]
    with pytest.raises(PySparkException):
        engine.query("CREATE u:2 SET age = -1, low = 'x'")
    engine.query("DEFINE TABLE s SCHEMAFULL; DEFINE FIELD a ON s TYPE int")
    assert engine.value("CREATE s:1 SET a = 1, b = 2") == [{"id": "s:1", "a": 1}]


def test_references(engine):
    engine.query("CREATE o:1 SET n = 1; DEFINE FIELD org ON t TYPE record<o> REFERENCE ON DELETE CASCADE; CREATE t:1 SET org = o:1; CREATE t:2 SET org = o:2")
    assert engine.value("SELECT org.n AS n FROM t:1") == [{"n": 1}]
    engine.query("DELETE o:1")
    assert engine.value("SELECT id FROM t") == [{"id": "t:2"}]


def test_unique_index(engine):
    engine.query("DEFINE INDEX e ON p FIELDS mail UNIQUE; CREATE p:1 SET mail = 'a'")
    with pytest.raises(QueryError):
        engine.query("CREATE p:2 SET mail = 'a'")


def test_transaction_and_version(engine):
    import datetime as dt
    import time

    engine.query("CREATE p:a SET v = 1")
    then = dt.datetime.now(dt.timezone.utc)
    time.sleep(0.05)
    engine.query("UPDATE p SET v = 2; BEGIN; DELETE p; CANCEL")
    assert engine.value("SELECT v FROM p") == [{"v": 2}]
    assert engine.value("SELECT v FROM p VERSION $then", {"then": then}) == [{"v": 1}]


def test_control_flow(engine):
    assert engine.value("FOR $i IN 1..=5 { IF $i = 2 { CONTINUE }; IF $i = 4 { BREAK }; CREATE n SET v = $i; }; SELECT VALUE v FROM n ORDER BY v") == [{"v": 1}, {"v": 3}]
    assert engine.value("LET $f = |$x| $x * 2; RETURN $f(4)") == 8
    assert engine.value("DEFINE FUNCTION fn::up($a: int) { IF $a > 3 { RETURN 'big' }; RETURN 'small' }; RETURN fn::up(5)") == "big"
    with pytest.raises(Thrown):
        engine.query("THROW 'no'")


def test_events_and_views(engine):
    engine.query("DEFINE EVENT e ON a WHEN $event = 'CREATE' THEN { CREATE log SET what = $after.v }; CREATE a:1 SET v = 7; UPDATE a SET v = 8")
    assert engine.value("SELECT what FROM log") == [{"what": 7}]
    engine.query("DEFINE TABLE sums AS SELECT count() AS n, math::sum(v) AS s FROM a GROUP ALL; CREATE a:2 SET v = 2")
    assert engine.value("SELECT * FROM sums") == [{"n": 2, "s": 10}]


def test_live_query(engine):
    key = engine.query("CREATE a:1 SET v = 1; LIVE SELECT * FROM a WHERE v > 5")[-1]
    engine.query("UPDATE a:1 SET v = 3; UPDATE a:1 SET v = 9; CREATE a:2 SET v = 6")
    assert [(r.op, r.id) for r in live.taken(engine.catalog, key).orderBy("id").collect()] == [("UPDATE", "a:1"), ("CREATE", "a:2")]
    engine.query(f"KILL '{key}'")
    with pytest.raises(QueryError):
        engine.query(f"KILL '{key}'")


def test_live_differences(engine):
    key = engine.query("CREATE a:1 SET v = 1; LIVE SELECT DIFF FROM a; ")[-1]
    engine.query("UPDATE a:1 SET v = 2")
    assert [r.result for r in live.taken(engine.catalog, key).collect()] == ['[{"op":"replace","path":"/v","value":2}]']


def test_only(engine):
    engine.query("CREATE p:a SET v = 1; CREATE p:b SET v = 2")
    assert engine.value("SELECT v FROM ONLY p:a") == {"v": 1}
    assert engine.value("SELECT v FROM ONLY p:zz") is None
    with pytest.raises(QueryError):
        engine.query("SELECT v FROM ONLY p")


def test_methods(engine, tmp_path):
    engine.create("p:a", {"v": 1})
    engine.insert("p", [{"id": "b", "v": 2}])
    engine.update("p:b", {"v": 5})
    assert sorted(r.v for r in engine.select("p").collect()) == [1, 5]
    assert engine.run("math::sum", [1, 2]) == 3
    assert engine.export(f"file://{tmp_path}/out") == ["p"]
    from omniframe.engine import Engine

    again = Engine(engine.spark).load(f"file://{tmp_path}/out", ["p"])
    assert again.value("SELECT count() AS n FROM p GROUP ALL") == [{"n": 2}]


def test_bucket_and_files(spark, tmp_path):
    from omniframe.sources import storage

    b = storage.Bucket(spark, f"file://{tmp_path}/bucket")
    assert b.put("a/x.txt", "hello") and not b.put("a/x.txt", "no", True)
    assert b.get("a/x.txt") == b"hello" and b.head("a/x.txt")["size"] == 5
    b.copy("a/x.txt", "a/y.txt")
    b.rename("a/y.txt", "b/z.txt")
    assert [x["key"] for x in b.list()] == ["a/x.txt", "b/z.txt"]
    b.delete("a/x.txt")
    assert not b.exists("a/x.txt")
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    for kind in ("parquet", "json", "csv", "orc"):
        storage.write(df, kind, f"file://{tmp_path}/{kind}")
        assert storage.read(spark, kind, f"file://{tmp_path}/{kind}", "k int, s string").collect()[0].s == "a"


def test_file_functions(engine, tmp_path):
    engine.query(f"DEFINE BUCKET b BACKEND 'file://{tmp_path}/b'")
    assert engine.value("RETURN file::put(f'b:/x/a.txt', 'hi'); RETURN file::exists(f'b:/x/a.txt')") is True
    assert engine.value("RETURN <string>file::get(f'b:/x/a.txt')") == "hi"
    engine.query("RETURN file::copy(f'b:/x/a.txt', 'x/b.txt'); RETURN file::rename(f'b:/x/b.txt', 'x/c.txt'); RETURN file::delete(f'b:/x/a.txt')")
    assert engine.value("RETURN file::list('b')") == ["x/c.txt"]
    assert engine.value("RETURN file::bucket(f'b:/x/c.txt')") == "b"


def test_blake3_over_many_chunks():
    from omniframe.functions.codecs import blake3

    # the digests differ by length and are stable across the tree's shapes
    got = [blake3("a" * n) for n in (0, 1, 64, 65, 1024, 1025, 2048, 3073, 5000)]
    assert len(set(got)) == len(got) and got[1] == "17762fddd969a453925d65717ac3eea21320b66b54342fde15128d6caf21215f"


def test_incremental_view_takes_rows_back(spark, tmp_path):
    from omniframe.streaming.views import View

    rows = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "g string, v double")
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    v = View(["g"], {"n": ("count", None), "hi": ("max", "v"), "s": ("sum", "v")}, f"file://{tmp_path}/view", lambda: left)
    v.apply(rows)
    v.apply(deleted=spark.createDataFrame([("a", 5.0)], "g string, v double"))
    assert {r.g: (r.n, r.hi, r.s) for r in v.read(spark).collect()} == {"a": (1, 1.0, 1.0), "b": (1, 2.0, 2.0)}


def test_view_counts_a_repeated_batch_once(spark, tmp_path):
    from omniframe.streaming.views import View

    outs = {"n": ("count", None), "s": ("sum", "v"), "sd": ("stddev", "v")}
    frame = lambda *v: spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    v = View(["g"], outs, f"file://{tmp_path}/view")
    v.apply(frame(1e9, 1e9 + 1), batch=0)
    v.apply(frame(1e9 + 2), batch=1)
    v.apply(frame(1e9 + 2), batch=1)  # the stream plays it again
    again = View(["g"], outs, f"file://{tmp_path}/view")  # a driver that starts anew
    again.apply(frame(1e9 + 3), batch=2)
    got = again.read(spark).first()
    assert (got.n, got.s) == (4, 4e9 + 6) and abs(got.sd - (5 / 3) ** 0.5) < 1e-6
    assert again.versions(spark) == [1, 2, 3]


def test_shared_folder_is_wanted_on_a_cluster(spark):
    from types import SimpleNamespace

    from omniframe.sources import storage

    def session(master, folder=None):
        get = lambda *_: folder
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=get), master=master), conf=SimpleNamespace(get=get))

    assert storage.shared(session("spark://x:7077", "hdfs://y/z/")) == "hdfs://y/z" and storage.shared(session("local[4]")).startswith("file://")
    with pytest.raises(RuntimeError):
        storage.shared(session("spark://x:7077"))
