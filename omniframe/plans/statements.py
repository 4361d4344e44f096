"""Parsing of all statements but SELECT's clauses."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from omniframe.plans import ast as A

if TYPE_CHECKING:
    from omniframe.plans.parser import Parser


def parse(p: Parser) -> A.Node:
    word = p.next().text.upper()
    return globals()[f"_{word.lower()}"](p)


def _select(p: Parser) -> A.Node:
    return p.select()


def _explain(p: Parser) -> A.Node:
    analyze = bool(p.word("ANALYZE"))
    if p.word("FORMAT"):
        p.want_word("TEXT", "JSON")
    inner = p.statement()
    return A.Statement("EXPLAIN", {"statement": inner, "analyze": analyze})


def _data(p: Parser, c: dict[str, Any]) -> bool:
    """A clause that says what to write."""
    if p.word("SET"):
        c.setdefault("set", []).extend(_assignments(p))
    elif p.word("UNSET"):
        c["unset"] = p.several()
    elif w := p.word("CONTENT", "MERGE", "PATCH", "REPLACE"):
        c[w.lower()] = p.expr()
    else:
        return False
    return True


def _assignments(p: Parser) -> list[tuple[A.Node, str, A.Node]]:
    out = []
    while True:
        target = p.postfix(p.primary())
        op = next((o for o in ("=", "+=", "-=", "+?=") if p.op(o)), None) or p.fail("an assignment")
        out.append((target, op, p.statement_value()))
        if not p.op(","):
            return out


def _tail(p: Parser, c: dict[str, Any]) -> None:
    """Clauses that all writing statements share."""
    while True:
        if _data(p, c):
            continue
        if p.word("WHERE"):
            c["where"] = p.expr()
        elif p.word("RETURN"):
            c["return"] = _returned(p)
        elif p.word("TIMEOUT"):
            c["timeout"] = p.expr()
        elif p.word("PARALLEL"):
            pass
        elif p.word("VERSION"):
            c["version"] = p.expr()
        else:
            return


def _returned(p: Parser) -> Any:
    if w := p.word("NONE", "NULL", "DIFF", "AFTER", "BEFORE"):
        return w.lower()
    if p.word("VALUE"):
        return ("value", p.expr())
    cols = []
    while True:
        cols.append(A.Column(None, None) if p.op("*") else A.Column(p.expr(), p.alias()))
        if not p.op(","):
            return ("fields", cols)


def _write(kind: str, p: Parser) -> A.Node:
    c: dict[str, Any] = {}
    if kind == "DELETE":
        p.word("FROM")
    c["only"] = bool(p.word("ONLY"))
    c["targets"] = p.several()
    _tail(p, c)
    return A.Statement(kind, c)


def _create(p: Parser) -> A.Node:
    return _write("CREATE", p)


def _update(p: Parser) -> A.Node:
    return _write("UPDATE", p)


def _upsert(p: Parser) -> A.Node:
    return _write("UPSERT", p)


def _delete(p: Parser) -> A.Node:
    return _write("DELETE", p)


def _insert(p: Parser) -> A.Node:
    c: dict[str, Any] = {"relation": False, "ignore": False}
    while w := p.word("RELATION", "IGNORE"):
        c[w.lower()] = True
    if p.word("INTO"):
        c["into"] = p.name()
    if p.is_op("(") and not p.is_word("SELECT", k=1):
        p.next()
        names = []
        while not p.op(")"):
            names.append(p.name())
            p.op(",")
        p.want_word("VALUES")
        rows = []
        while True:
            p.want("(")
            rows.append(A.Obj(list(zip(names, p.listed(")")))))
            if not p.op(","):
                break
        c["rows"] = A.Array(rows)
    else:
        c["rows"] = p.statement_value()
    if p.word("ON"):
        p.want_word("DUPLICATE")
        p.want_word("KEY")
        p.want_word("UPDATE")
        c["duplicate"] = _assignments(p)
    if p.word("RETURN"):
        c["return"] = _returned(p)
    return A.Statement("INSERT", c)


def _relate(p: Parser) -> A.Node:
    c: dict[str, Any] = {"only": bool(p.word("ONLY"))}
    source = p.primary()
    backwards = False
    if p.op("<-"):
        backwards = True
    else:
        p.want("->")
    table = p.name()
    if p.op(":"):
        table = A.RecordId(table, A.Lit(p.next().value))
    p.want("<-" if backwards else "->")
    target = p.primary()
    c |= {"from": target if backwards else source, "edge": table, "to": source if backwards else target, "unique": bool(p.word("UNIQUE"))}
    _tail(p, c)
    return A.Statement("RELATE", c)


def _live(p: Parser) -> A.Node:
    p.want_word("SELECT")
    c: dict[str, Any] = {"diff": False}
    if p.word("DIFF"):
        c["diff"] = True
        c["select"] = A.Select()
        p.want_word("FROM")
        c["select"].sources = p.several()
        if p.word("WHERE"):
            c["select"].where = p.expr()
    else:
        c["select"] = p.select()
    return A.Statement("LIVE", c)


def _kill(p: Parser) -> A.Node:
    return A.Statement("KILL", {"id": p.expr()})


def _show(p: Parser) -> A.Node:
    p.want_word("CHANGES")
    p.want_word("FOR")
    p.want_word("TABLE")
    c: dict[str, Any] = {"table": p.name(), "since": None, "limit": None}
    if p.word("SINCE"):
        c["since"] = p.expr()
    if p.word("LIMIT"):
        c["limit"] = p.expr()
    return A.Statement("SHOW", c)


def _let(p: Parser) -> A.Node:
    name = p.next().value
    if p.op(":"):
        p.kind()
    p.want("=")
    return A.Statement("LET", {"name": name, "value": p.statement_value()})


def _return(p: Parser) -> A.Node:
    c = {"value": p.statement_value()}
    if p.word("FETCH"):
        c["fetch"] = p.several()
    return A.Statement("RETURN", c)


def _if(p: Parser) -> A.Node:
    return A.Statement("IF", {"if": p.if_else()})


def _for(p: Parser) -> A.Node:
    name = p.next().value
    p.want_word("IN")
    return A.Statement("FOR", {"name": name, "in": p.statement_value(), "body": p.block()})


def _sleep(p: Parser) -> A.Node:
    return A.Statement("SLEEP", {"for": p.expr()})


def _option(p: Parser) -> A.Node:
    name = p.name()
    value = p.expr() if p.op("=") else A.Lit(True)
    return A.Statement("OPTION", {"name": name, "value": value})


def _use(p: Parser) -> A.Node:
    c = {}
    while w := p.word("NS", "NAMESPACE", "DB", "DATABASE"):
        c["ns" if w[0] == "N" else "db"] = p.name()
    return A.Statement("USE", c)


def _begin(p: Parser) -> A.Node:
    p.word("TRANSACTION")
    return A.Statement("BEGIN")


def _cancel(p: Parser) -> A.Node:
    p.word("TRANSACTION")
    return A.Statement("CANCEL")


def _commit(p: Parser) -> A.Node:
    p.word("TRANSACTION")
    return A.Statement("COMMIT")


def _throw(p: Parser) -> A.Node:
    return A.Statement("THROW", {"value": p.expr()})


def _break(p: Parser) -> A.Node:
    return A.Statement("BREAK")


def _continue(p: Parser) -> A.Node:
    return A.Statement("CONTINUE")


def _access(p: Parser) -> A.Node:
    p.fail("a statement other than ACCESS, which is not part of this engine")


def _info(p: Parser) -> A.Node:
    p.want_word("FOR")
    what = p.want_word("ROOT", "NS", "NAMESPACE", "DB", "DATABASE", "TABLE", "INDEX", "USER")
    c: dict[str, Any] = {"what": {"NAMESPACE": "NS", "DATABASE": "DB"}.get(what, what)}
    if c["what"] in ("TABLE", "INDEX", "USER"):
        c["name"] = p.name()
    if p.word("ON"):
        p.word("TABLE", "ROOT", "NAMESPACE", "DATABASE")
        if p.tok.kind == "word":
            c["on"] = p.name()
    p.word("STRUCTURE")
    return A.Statement("INFO", c)


def _rebuild(p: Parser) -> A.Node:
    p.want_word("INDEX")
    if p.word("IF"):
        p.want_word("EXISTS")
    name = p.name()
    p.want_word("ON")
    p.word("TABLE")
    return A.Statement("REBUILD", {"name": name, "table": p.name()})


def _remove(p: Parser) -> A.Node:
    what = p.name().upper()
    exists = False
    if p.word("IF"):
        p.want_word("EXISTS")
        exists = True
    name = p.next().value
    c = {"what": what, "name": name, "if_exists": exists}
    if p.word("ON"):
        p.word("TABLE")
        c["table"] = p.name()
    return A.Statement("REMOVE", c)


def _alter(p: Parser) -> A.Node:
    return _define(p, "ALTER")


def _define(p: Parser, kind: str = "DEFINE") -> A.Node:
    what = p.name().upper()
    c: dict[str, Any] = {"what": {"NS": "NAMESPACE", "DB": "DATABASE"}.get(what, what), "mode": ""}
    if p.word("OVERWRITE"):
        c["mode"] = "overwrite"
    elif p.word("IF"):
        p.word("NOT")
        p.want_word("EXISTS")
        c["mode"] = "if_not_exists"
    if c["what"] == "FIELD":
        c["name"] = ".".join(str(x.value) if x.kind == "field" else "*" for x in p.postfix(p.primary()).parts)
    else:
        c["name"] = p.next().value
    if c["what"] == "FUNCTION":
        c["params"] = []
        p.want("(")
        while not p.op(")"):
            name = p.next().value
            p.want(":")
            c["params"].append((name, p.kind()))
            p.op(",")
        if p.op("->"):
            c["returns"] = p.kind()
        c["body"] = p.block()
    while not p.is_op(";") and p.tok.kind != "end" and not p.is_op("}"):
        _define_clause(p, c)
    return A.Statement(kind, c)


def _define_clause(p: Parser, c: dict[str, Any]) -> None:
    w = p.next()
    word = str(w.text).upper()
    if word == "ON":
        p.word("TABLE")
        c["table"] = p.name()
    elif word in ("SCHEMAFULL", "SCHEMALESS", "DROP", "FLEXIBLE", "READONLY", "UNIQUE", "COUNT", "ENFORCED", "CONCURRENTLY"):
        c[word.lower()] = True
    elif word == "TYPE":
        c["type"] = p.kind()
        if c["type"] == "relation":
            while d := p.word("IN", "OUT", "FROM", "TO"):
                c["in" if d in ("IN", "FROM") else "out"] = p.name()
    elif word in ("VALUE", "ASSERT", "WHEN", "COMPUTED", "DEFAULT", "THEN"):
        if word == "DEFAULT":
            p.word("ALWAYS")
        if word == "THEN" and p.is_op("{"):
            c["then"] = p.block()
        else:
            c[word.lower()] = p.statement_value()
    elif word == "AS":
        c["as"] = p.statement_value()
    elif word in ("FIELDS", "COLUMNS"):
        c["fields"] = p.several()
    elif word in ("TOKENIZERS", "FILTERS"):
        items = []
        while True:
            name = p.name().lower()
            items.append((name, [a.value if isinstance(a, A.Lit) else a.parts[0].value for a in p.arguments()] if p.is_op("(") else []))
            if not p.op(","):
                break
        c[word.lower()] = items
    elif word == "CHANGEFEED":
        c["changefeed"] = p.next().value
        if p.word("INCLUDE"):
            p.want_word("ORIGINAL")
            c["original"] = True
    elif word in ("FULLTEXT", "SEARCH", "HNSW", "MTREE"):
        c["index"] = word
    elif word in ("ANALYZER", "DIST", "DIMENSION", "COMMENT", "START", "BATCH", "TIMEOUT", "FUNCTION", "M", "EFC", "BACKEND", "STRICT"):
        c[word.lower()] = p.next().value
    elif word == "BM25":
        c["bm25"] = [a.value for a in p.arguments()] if p.is_op("(") else []
    elif word == "HIGHLIGHTS":
        c["highlights"] = True
    elif word == "REFERENCE":
        c["reference"] = "ignore"
        if p.word("ON"):
            p.want_word("DELETE")
            c["reference"] = p.name().lower()
    elif word == "PERMISSIONS":
        while p.word("NONE", "FULL", "FOR", "SELECT", "CREATE", "UPDATE", "DELETE", "WHERE") or p.op(","):
            if p.toks[p.i - 1].text.upper() == "WHERE":
                c["permissions"] = p.expr()
    else:
        p.i -= 1
        p.fail("a clause")
