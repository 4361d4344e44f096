import pytest

from omniframe.plans import ast as A
from omniframe.plans.lexer import QuerySyntaxError, nanos
from omniframe.plans.parser import parse, parse_expr


def test_precedence():
    n = parse_expr("1 + 2 * 3 = 7 AND true OR false")
    assert n.op == "OR" and n.left.op == "AND" and n.left.left.op == "="
    assert n.left.left.left.right.op == "*"


def test_clauses():
    (s,) = parse("SELECT a, count() AS n OMIT b FROM t, u WHERE x > 1 SPLIT a GROUP BY a ORDER BY n DESC, a LIMIT 3 START 1 FETCH a TIMEOUT 5s")
    assert [c.alias for c in s.columns] == [None, "n"] and len(s.sources) == 2
    assert s.order[0].descending and not s.order[1].descending
    assert s.limit.value == 3 and s.start.value == 1 and s.timeout.kind == "duration"


def test_paths():
    n = parse_expr("a.b[0].c[WHERE x > 1].{d, e: f.g}->knows->person.name")
    assert [p.kind for p in n.parts] == ["field", "field", "index", "field", "where", "destructure", "graph", "graph", "field"]
    r = parse_expr("person:a.{1..4+path}(->knows->person)").parts[0]
    assert r.kind == "recurse" and (r.value.least, r.value.most, r.value.instruction) == (1, 4, "path")


def test_literals():
    assert nanos("1h30m") == 5400 * 10**9
    assert parse_expr("1_000").value == 1000
    assert parse_expr("'it\\'s'").value == "it's"
    assert parse_expr("/a\\/b/").value == "a/b"
    assert isinstance(parse_expr("|t:1..5|"), A.Mock)
    assert parse_expr("person:1..=5").key.inclusive
    assert parse_expr("-5").value == -5
    assert parse_expr("1.5dec").kind == "decimal"


def test_value_is_a_name_too():
    (s,) = parse("SELECT value * 2 AS x FROM t")
    assert not s.value
    (s,) = parse("SELECT VALUE x FROM t")
    assert s.value


@pytest.mark.parametrize("text", ["SELECT FROM", "SELECT * FROM t WHERE", "RETURN (1", "DEFINE FIELD", "SELECT * FROM t ORDER", "RETURN 'open"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize(
    "text",
    [
        "DEFINE TABLE t SCHEMAFULL CHANGEFEED 1d INCLUDE ORIGINAL",
        "DEFINE FIELD a.b ON TABLE t TYPE option<record<u>> DEFAULT 5 ASSERT $value > 1",
        "DEFINE INDEX i ON t FIELDS a, b UNIQUE",
        "DEFINE INDEX f ON t FIELDS a FULLTEXT ANALYZER x BM25(1.2, 0.75) HIGHLIGHTS",
        "DEFINE EVENT e ON t WHEN $event = 'CREATE' THEN { CREATE log SET a = 1 }",
        "DEFINE ANALYZER x TOKENIZERS blank, class FILTERS lowercase, edgengram(2, 5)",
        "REMOVE TABLE IF EXISTS t",
        "ALTER TABLE t SCHEMALESS",
        "INSERT IGNORE INTO t (a, b) VALUES (1, 2), (3, 4)",
        "RELATE a:1->likes->b:2 SET x = 1",
        "LIVE SELECT DIFF FROM t WHERE a > 1",
        "SHOW CHANGES FOR TABLE t SINCE 5 LIMIT 10",
        "USE NS a DB b",
        "IF true { 1 } ELSE { 2 }",
        "FOR $i IN 1..3 { CONTINUE }",
        "INFO FOR TABLE t",
        "KILL 'x'",
        "REBUILD INDEX i ON t",
    ],
)
def test_statements(text):
    assert len(parse(text)) == 1
