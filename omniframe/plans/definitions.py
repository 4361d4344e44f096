"""DEFINE, ALTER, REMOVE and INFO: the catalog's objects."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from omniframe.plans import ast as A
from omniframe.plans.catalog import Edge, Table
from omniframe.plans.compiler import QueryError
from omniframe.plans.planner import Planner, default_name

if TYPE_CHECKING:
    from omniframe.plans.runner import Runner

EMPTY = T.StructType([T.StructField("id", T.StringType())])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "in", "out")])


def ensure(r: Runner, name: str, edge: bool = False) -> Table:
    """The table, made empty if it is not there yet."""
    c = r.catalog
    if name not in c.tables:
        c.add(name, r.spark.createDataFrame([], EDGE if edge else EMPTY), key="id")
        if edge:
            c.tables[name].edge = Edge("in", "", "out", "")
    return c.tables[name]


#: What would be accepted and then not enforced or run is refused instead.
REFUSED = ("ACCESS", "USER", "API", "CONFIG", "MODEL", "MODULE", "SYSTEM")
FILTERS = ("lowercase", "uppercase", "ascii", "edgengram", "ngram", "snowball")


def refuse(what: str, c: dict[str, Any]) -> None:
    if what in REFUSED:
        raise QueryError(f"DEFINE {what} is not supported")
    if c.get("permissions") not in (None, "", "FULL", "full", True):
        raise QueryError("PERMISSIONS other than FULL are not supported")
    if what == "ANALYZER":
        for name, args in c.get("filters", []):
            if name not in FILTERS:
                raise QueryError(f"the filter {name} is not supported")
            if name == "snowball" and args and str(args[0]).lower() not in ("english", "en", "eng"):
                raise QueryError(f"snowball({args[0]}) is not supported, only english is")


def define(r: Runner, c: dict[str, Any], alter: bool) -> None:
    cat, what, name = r.catalog, c["what"], c["name"]
    refuse(what, c)
    held = cat.objects.setdefault(what, {})
    if what in ("FIELD", "INDEX", "EVENT"):
        t = ensure(r, c["table"])
        kind = {"FIELD": "fields", "INDEX": "indexes", "EVENT": "events"}[what]
        own = t.info.setdefault(kind, {})
        if name in own and not alter and not c["mode"]:
            raise QueryError(f"{what.lower()} {name} is already defined")
        if c["mode"] == "if_not_exists" and name in own:
            return
        own[name] = (own.get(name, {}) if alter else {}) | c
        if what == "FIELD":
            kind_ = str(c.get("type", ""))
            if "record<" in kind_:
                t.links[name] = kind_.split("record<")[1].split(">")[0].split("|")[0]
            if "computed" in c:
                t.info.setdefault("computed", {})[name] = c["computed"]
        if what == "INDEX" and c.get("unique"):
            check_unique(r, t, c)
        return
    exists = name in held or what == "TABLE" and name in cat.tables
    if exists and c["mode"] == "if_not_exists":
        return
    if exists and not alter and not c["mode"] and what != "TABLE":
        raise QueryError(f"{what.lower()} {name} is already defined")
    held[name] = (held.get(name, {}) if alter else {}) | c
    if what == "FUNCTION":
        cat.functions[name] = c
    elif what == "PARAM":
        cat.params[name] = r.value(c["value"])
    elif what == "ANALYZER":
        cat.analyzers[name] = {"tokenizers": c.get("tokenizers", []), "filters": c.get("filters", [])}
    elif what == "TABLE":
        if isinstance(c.get("as"), A.Select):
            view(r, name, c["as"])
        else:
            t = ensure(r, name, c.get("type") == "relation")
            if c.get("type") == "relation":
                t.edge = Edge("in", c.get("in", ""), "out", c.get("out", ""))
        cat.tables[name].info.update({k: v for k, v in c.items() if k in ("schemafull", "changefeed", "original", "drop", "permissions")})


def check_unique(r: Runner, t: Table, c: dict[str, Any]) -> None:
    fields = [default_name(f) for f in c.get("fields", [])]
    df = t.df()
    if all(f in df.columns for f in fields) and not df.dropna(subset=fields).groupBy(*fields).count().filter("count > 1").isEmpty():
        raise QueryError(f"index {c['name']}: the table holds repeated values")


def view(r: Runner, name: str, s: A.Select) -> None:
    """A view is planned anew whenever it is read, so it follows every write."""
    r.catalog.add(name, lambda: Planner(r.catalog).select(s))
    r.catalog.tables[name].info["view"] = s


def remove(r: Runner, c: dict[str, Any]) -> None:
    cat, what, name = r.catalog, c["what"], c["name"]
    if what in ("FIELD", "INDEX", "EVENT"):
        t = cat.table(c["table"])
        kind = {"FIELD": "fields", "INDEX": "indexes", "EVENT": "events"}[what]
        if t.info.get(kind, {}).pop(name, None) is None and not c["if_exists"]:
            raise QueryError(f"there is no {what.lower()} {name}")
        if what == "FIELD":
            t.links.pop(name, None)
        return
    found = cat.objects.get(what, {}).pop(name, None)
    if what == "TABLE":
        found = cat.tables.pop(name, None) or found
    elif what == "FUNCTION":
        found = cat.functions.pop(name, None) or found
    elif what == "PARAM":
        cat.params.pop(name, None)
    elif what == "ANALYZER":
        cat.analyzers.pop(name, None)
    if found is None and not c["if_exists"]:
        raise QueryError(f"there is no {what.lower()} {name}")


def info(r: Runner, c: dict[str, Any]) -> DataFrame:
    """(kind, name, detail) of what is defined."""
    cat, rows = r.catalog, []
    if c["what"] == "TABLE":
        t = cat.table(c["name"])
        for kind in ("fields", "indexes", "events"):
            rows += [(kind, n, str({k: v for k, v in d.items() if isinstance(v, (str, bool, int))})) for n, d in t.info.get(kind, {}).items()]
    elif c["what"] == "INDEX":
        tables = [cat.table(c["on"])] if c.get("on") else list(cat.tables.values())
        found = [(t, t.info["indexes"][c["name"]]) for t in tables if c["name"] in t.info.get("indexes", {})]
        if not found:
            raise QueryError(f"there is no index {c['name']}")
        # an index is a layout that is derived when read, so there is nothing left to build
        rows += [("index", c["name"], f"ready: {t.name}({', '.join(default_name(f) for f in d.get('fields', []))})") for t, d in found]
    elif c["what"] == "USER":
        raise QueryError(f"there is no user {c['name']}")
    elif c["what"] in ("ROOT", "NS"):
        rows.append(("namespaces", cat.session["ns"], "") if c["what"] == "ROOT" else ("databases", cat.session["db"], ""))
    else:
        rows += [("tables", n, "view" if "view" in t.info else "edge" if t.edge else "table") for n, t in cat.tables.items()]
        rows += [(what.lower() + "s", n, "") for what, held in cat.objects.items() if what != "TABLE" for n in held]
    return r.spark.createDataFrame(sorted(rows), "kind string, name string, detail string")
