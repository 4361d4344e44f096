"""Walks through several edge tables, their order and bounds, recursion, and what is refused."""

import pytest

from omniframe.operators import graph


@pytest.fixture()
def people(engine):
    engine.query(
        "CREATE p:a SET n = 'A'; CREATE p:b SET n = 'B'; CREATE p:c SET n = 'C'; CREATE s:x SET n = 'X'; "
        "RELATE p:a->knows->p:b SET w = 1; RELATE p:a->knows->p:c SET w = 5; RELATE p:b->knows->p:c SET w = 2; RELATE p:a->likes->p:c SET w = 3; RELATE p:a->likes->s:x SET w = 4"
    )
    return engine


def ends(engine, path):
    return {r["n"]: sorted(r["v"]) for r in engine.value(f"SELECT n, {path} AS v FROM p")}


def test_several_edge_tables(people):
    assert ends(people, "->(knows, likes)->p.n") == {"A": ["B", "C", "C"], "B": ["C"], "C": []}
    assert ends(people, "->?->p.n") == {"A": ["B", "C", "C"], "B": ["C"], "C": []}
    assert ends(people, "->?->?.n") == {"A": ["B", "C", "C", "X"], "B": ["C"], "C": []}
    assert ends(people, "->(likes, knows)->(s, p).n") == {"A": ["B", "C", "C", "X"], "B": ["C"], "C": []}
    assert ends(people, "<-?<-p.n") == {"A": [], "B": ["A"], "C": ["A", "A", "B"]}
    assert ends(people, "->(knows, likes WHERE w > 2)->?") == {"A": ["p:c", "p:c", "s:x"], "B": [], "C": []}
    assert {r["n"]: r["c"] for r in people.value("SELECT n, count(->?) AS c FROM p")} == {"A": 4, "B": 1, "C": 0}
    assert all(len(x) == len(set(x)) for x in ends(people, "->?").values())


def test_order_start_and_limit_of_a_step(people):
    got = people.value("SELECT n, ->(knows ORDER BY w DESC LIMIT 1).w AS one, ->(knows ORDER BY w DESC START 1).w AS rest FROM p WHERE n = 'A'")
    assert got == [{"n": "A", "one": [5], "rest": [1]}]
    with pytest.raises(ValueError, match="last step"):
        people.value("SELECT ->(knows LIMIT 1)->p AS v FROM p")


def test_a_length_is_counted_not_gathered(people):
    sizes = lambda path: {r["n"]: (r["a"], r["d"]) for r in people.value(f"SELECT n, array::len({path}) AS a, array::len(array::distinct({path})) AS d FROM p")}
    assert sizes("->(knows, likes)->p") == {"A": (3, 2), "B": (1, 1), "C": (0, 0)}
    assert sizes("->?->?") == {"A": (4, 3), "B": (1, 1), "C": (0, 0)}
    assert sizes("->knows->p->knows->p") == {"A": (1, 1), "B": (0, 0), "C": (0, 0)}
    assert sizes("->likes->p<-knows<-p") == {"A": (2, 2), "B": (0, 0), "C": (0, 0)}
    assert sizes("->(knows WHERE w < 5)->p->?->(p WHERE n = 'C')") == {"A": (1, 1), "B": (0, 0), "C": (0, 0)}
    assert sizes("->likes") == {"A": (2, 2), "B": (0, 0), "C": (0, 0)}
    assert sizes("->(knows ORDER BY w LIMIT 1)") == {"A": (1, 1), "B": (1, 1), "C": (0, 0)}


def test_two_hops_shuffle_no_order_and_no_lists(spark):
    from omniframe import queries

    plan = queries.QUERIES["graph_two_hops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "collect_list" not in physical and "l_linenumber" not in physical


def test_recursion_over_several_tables(people):
    got = {r["n"]: sorted(r["v"] or []) for r in people.value("SELECT n, id.{..+collect}(->(knows, likes)->?) AS v FROM p")}
    assert got == {"A": ["p:b", "p:c", "s:x"], "B": ["p:c"], "C": []}
    some = {r["n"]: sorted(r["v"] or []) for r in people.value("SELECT n, id.{..+collect}(->(knows WHERE w < 5)->p) AS v FROM p")}
    assert some["A"] == ["p:b", "p:c"] and some["B"] == ["p:c"]


def test_recursion_ends_with_an_error(spark):
    hop = spark.range(300).selectExpr("id AS _from", "id + 1 AS _to")
    start = spark.range(1)
    with pytest.raises(graph.RecursionLimit):
        graph.recurse(start, hop, "default", 1, 1000)
    old, graph.MOST_LEVELS = graph.MOST_LEVELS, 4
    try:
        for how in ("collect", "path", "default"):
            with pytest.raises(graph.RecursionLimit):
                graph.recurse(start, hop, how)
        with pytest.raises(graph.RecursionLimit):
            graph.recurse(start, hop, "shortest", target=200)
        assert [r.path for r in graph.recurse(start, hop, "shortest", target=3).collect()] == [[1, 2, 3]]
        assert graph.recurse(start, hop, "collect", 1, 3).count() == 3
    finally:
        graph.MOST_LEVELS = old


@pytest.mark.parametrize("how", ["default", "collect", "path", "shortest"])
def test_no_level_is_sent_through_the_driver(spark, monkeypatch, how):
    plans, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    hop = spark.range(2, 30).selectExpr("id AS _from", "id div 2 AS _to")
    got = graph.recurse(spark.range(1, 30), hop, how, target=3 if how == "shortest" else None)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    assert got.count() == {"default": 28, "collect": sum(k.bit_length() - 1 for k in range(2, 30)), "path": 28, "shortest": 12}[how]


def test_no_level_of_a_tree_is_sent_through_the_driver(spark):
    hop = spark.range(2, 30).selectExpr("id div 2 AS _from", "id AS _to")
    got = graph.tree(spark.range(1, 30), hop, 2)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0
    assert {r.start: len(r.tree.children) for r in got.collect()} == {k: max(0, min(2, 30 - 2 * k)) for k in range(1, 30)}


def test_shortest_takes_the_smallest_of_equals(spark):
    pairs = [(0, 2), (0, 1), (1, 3), (2, 3), (3, 0), (3, 4), (2, 5), (5, 4)]
    hop = spark.createDataFrame(pairs, "_from long, _to long")
    got = graph.recurse(spark.range(4), hop, "shortest", target=4, inclusive=True)
    assert {r.start: r.path for r in got.collect()} == {0: [0, 1, 3, 4], 1: [1, 3, 4], 2: [2, 3, 4], 3: [3, 4]}


@pytest.mark.parametrize(
    "text",
    [
        "DEFINE ACCESS a ON DATABASE TYPE RECORD", "DEFINE USER u ON ROOT PASSWORD 'x'", "DEFINE ANALYZER a TOKENIZERS blank FILTERS mapper('x')", "DEFINE ANALYZER a TOKENIZERS blank FILTERS snowball(german)",
        "DEFINE TABLE t PERMISSIONS FOR select WHERE a = 1", "INFO FOR USER root", "INFO FOR INDEX nope", "SELECT ->nope->p FROM p",
    ],
)
def test_refused_not_ignored(people, text):
    with pytest.raises((ValueError, KeyError)):
        people.query(text)
