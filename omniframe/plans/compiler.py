"""Expressions of the language to typed Spark SQL over one frame of rows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from omniframe.functions.scalar import SCALAR
from omniframe.plans import ast as A
from omniframe.plans.catalog import Catalog
from omniframe.plans.values import WHOLE, Val, arithmetic, compare, equal, quote, text, truthy

KINDS = {"int": "bigint", "float": "double", "number": "double", "string": "string", "bool": "boolean", "datetime": "timestamp", "decimal": "decimal(38,18)", "bytes": "binary", "uuid": "string", "duration": "interval day to second"}
CONSTANTS = {"math::pi": "pi()", "math::e": "e()", "math::tau": "(2 * pi())", "math::inf": "double('Infinity')", "math::neg_inf": "double('-Infinity')", "math::nan": "double('NaN')", "math::ln_2": "ln(2)", "math::ln_10": "ln(10)", "math::log2_10": "log2(10)", "math::log2_e": "log2(e())", "math::log10_2": "log10(2)", "math::log10_e": "log10(e())", "math::sqrt_2": "sqrt(2)", "math::frac_1_sqrt_2": "(1 / sqrt(2))", "math::frac_1_pi": "(1 / pi())", "math::frac_2_pi": "(2 / pi())", "math::frac_2_sqrt_pi": "(2 / sqrt(pi()))", "math::frac_pi_2": "(pi() / 2)", "math::frac_pi_3": "(pi() / 3)", "math::frac_pi_4": "(pi() / 4)", "math::frac_pi_6": "(pi() / 6)", "math::frac_pi_8": "(pi() / 8)", "time::epoch": "timestamp_seconds(0)", "duration::max": "make_dt_interval(106751991, 4, 0, 54)"}


class QueryError(ValueError):
    """The query is well formed but cannot be run."""


@dataclass
class Scope:
    """Where names are looked up: the frame's columns, parameters, and lambda variables."""

    catalog: Catalog
    df: DataFrame | None = None
    table: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    locals: dict[str, Val] = field(default_factory=dict)
    aliases: dict[str, Val] = field(default_factory=dict)
    hooks: Any = None  # the planner: links, graph lookups, subqueries
    this: Val | None = None

    def inner(self, **names: Val) -> Scope:
        out = Scope(self.catalog, self.df, self.table, self.params, self.locals | names, self.aliases, self.hooks, self.this)
        out.root = self.top
        return out

    root: Scope | None = None

    @property
    def top(self) -> Scope:
        return self.root or self

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark


_types: dict[tuple[str, str], T.DataType] = {}
_count = [0]


def infer(scope: Scope, sql: str) -> T.DataType:
    """The type of a piece of SQL over the scope's columns and lambda variables."""
    df = scope.top.df
    fields = list(df.schema.fields) if df is not None else []
    extra = [T.StructField(v.sql.strip("`"), v.type) for v in scope.locals.values() if re.fullmatch(r"`?_v\d+`?", v.sql)]
    schema = T.StructType([*fields, *[f for f in extra if f.name not in {x.name for x in fields}]])
    key = (schema.json(), sql)
    if key not in _types:
        _types[key] = scope.spark.createDataFrame([], schema).selectExpr(f"{sql} AS x").schema[0].dataType
    return _types[key]


def typed(scope: Scope, sql: str, literal: bool = False, link: str | None = None) -> Val:
    return Val(sql, infer(scope, sql), literal, link)


def lit(value: Any, scope: Scope | None = None) -> Val:
    """A Python value as a literal."""
    if value is None:
        return Val("NULL", T.NullType(), True)
    if isinstance(value, bool):
        return Val(str(value).lower(), T.BooleanType(), True)
    if isinstance(value, int):
        return Val(f"{value}L" if value >= 0 else f"({value}L)", T.LongType(), True)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return Val(f"double('{'NaN' if value != value else 'Infinity' if value > 0 else '-Infinity'}')", T.DoubleType(), True)
        return Val(f"{value!r}D" if value >= 0 else f"({value!r}D)", T.DoubleType(), True)
    if isinstance(value, str):
        return Val(text(value), T.StringType(), True)
    if isinstance(value, dt.datetime):
        return Val(f"TIMESTAMP {text(value.isoformat(' '))}", T.TimestampType(), True)
    if isinstance(value, dt.timedelta):
        us = (value.days * 86400 + value.seconds) * 10**6 + value.microseconds
        return Val(f"make_dt_interval(0, 0, 0, cast({us} / 1000000D as decimal(18,6)))", T.DayTimeIntervalType(), True)
    if isinstance(value, (list, tuple)):
        items = [lit(v) for v in value]
        kind = items[0].type if items else T.NullType()
        if any(isinstance(i.type, T.DoubleType) for i in items) and all(i.family == "number" for i in items):
            items = [Val(f"double({i.sql})", T.DoubleType(), True) for i in items]
            kind = T.DoubleType()
        if not items:
            return Val("array()", T.ArrayType(T.NullType()), True)
        return Val(f"array({', '.join(i.sql for i in items)})", T.ArrayType(kind), True)
    if isinstance(value, dict):
        items2 = {k: lit(v) for k, v in value.items()}
        if not items2:
            return Val("map()", T.MapType(T.StringType(), T.StringType()), True)
        return Val("named_struct(" + ", ".join(f"{text(k)}, {v.sql}" for k, v in items2.items()) + ")", T.StructType([T.StructField(k, v.type) for k, v in items2.items()]), True)
    if isinstance(value, bytes):
        return Val(f"X'{value.hex()}'", T.BinaryType(), True)
    raise QueryError(f"no literal for {type(value).__name__}")


def compile(node: A.Node, scope: Scope, pushable: bool = False) -> Val:
    """A node's typed SQL; pushable: it is a condition where NULL may stand for false."""
    return globals()[f"_{type(node).__name__.lower()}"](node, scope, pushable)


def condition(node: A.Node, scope: Scope) -> str:
    """A WHERE condition in a form that scans can use."""
    v = compile(node, scope, True)
    return v.sql if v.family == "bool" and isinstance(node, A.Bin) else truthy(v)


def _lit(n: A.Lit, scope: Scope, _: bool) -> Val:
    if n.kind == "duration":
        return Val(f"make_dt_interval(0, 0, 0, cast({n.value} / 1000000000D as decimal(18,6)))", T.DayTimeIntervalType(), True)
    if n.kind == "datetime":
        return Val(f"TIMESTAMP {text(n.value)}", T.TimestampType(), True)
    if n.kind == "regex":
        return Val(text(n.value), T.StringType(), True, tag="regex")
    if n.kind == "decimal":
        # 38 digits in all: what the whole part leaves, 18 at most, follow the point
        scale = max(min(18, 38 - len(str(n.value).lstrip("+-").partition(".")[0].lstrip("0"))), 0)
        return Val(f"cast('{n.value}' as decimal(38,{scale}))", T.DecimalType(38, scale), True)
    if n.kind == "bytes":
        return Val(f"X'{n.value}'", T.BinaryType(), True)
    return lit(n.value)


def _param(n: A.Param, scope: Scope, _: bool) -> Val:
    if n.name in scope.locals:
        return scope.locals[n.name]
    if n.name == "this":
        return this(scope)
    if n.name in scope.params:
        v = scope.params[n.name]
    elif n.name in scope.catalog.params:
        v = scope.catalog.params[n.name]
    else:
        return lit(None)
    if isinstance(v, DataFrame):
        return scope.top.hooks.frame_value(v)
    return v if isinstance(v, Val) else lit(v)


def this(scope: Scope) -> Val:
    if scope.this is not None:
        return scope.this
    if scope.top.df is None:
        return lit(None)
    names = scope.top.df.columns
    return typed(scope, "named_struct(" + ", ".join(f"{text(c)}, {quote(c)}" for c in names) + ")")


def _recordid(n: A.RecordId, scope: Scope, _: bool) -> Val:
    t = scope.catalog.tables.get(n.table)
    if t is not None and t.info.get("plain_key"):
        v = compile(n.key, scope)
        return Val(v.sql, v.type, v.literal, n.table)
    v = compile(n.key, scope)
    sql = text(f"{n.table}:{n.key.value}") if isinstance(n.key, A.Lit) else f"concat({text(n.table + ':')}, string({v.sql}))"
    return Val(sql, T.StringType(), v.literal, n.table)


def _range(n: A.Range, scope: Scope, _: bool) -> Val:
    lo = compile(n.begin, scope) if n.begin is not None else lit(None)
    hi = compile(n.end, scope) if n.end is not None else lit(None)
    v = typed(scope, f"named_struct('begin', {lo.sql}, 'end', {hi.sql}, 'skip', {str(n.skip).lower()}, 'inclusive', {str(n.inclusive).lower()})", lo.literal and hi.literal)
    v.tag = "range"
    return v


def sequence_of(n: A.Range, scope: Scope) -> Val:
    """A range of integers as an array."""
    lo, hi = compile(n.begin, scope), compile(n.end, scope)
    a = f"(bigint({lo.sql}) + 1)" if n.skip else f"bigint({lo.sql})"
    b = f"bigint({hi.sql})" if n.inclusive else f"(bigint({hi.sql}) - 1)"
    return Val(f"if({b} < {a}, cast(array() as array<bigint>), sequence({a}, {b}))", T.ArrayType(T.LongType()), lo.literal and hi.literal)


def _mock(n: A.Mock, scope: Scope, _: bool) -> Val:
    return Val(f"transform(sequence({n.begin}L, {n.end}L), i -> concat({text(n.table + ':')}, i))", T.ArrayType(T.StringType()), True)


def _array(n: A.Array, scope: Scope, _: bool) -> Val:
    items = [compile(i, scope) for i in n.items]
    if not items:
        return Val("array()", T.ArrayType(T.NullType()), True)
    families = {i.family for i in items} - {"none"}
    if len(families) > 1:  # values of several kinds are kept as text
        items = [Val(f"string({i.sql})", T.StringType(), i.literal) for i in items]
    if families == {"number"} and any(not isinstance(i.type, WHOLE) for i in items):
        items = [Val(f"double({i.sql})", T.DoubleType(), i.literal) for i in items]
    v = typed(scope, f"array({', '.join(i.sql for i in items)})", all(i.literal for i in items))
    v.link = items[0].link
    return v


def _obj(n: A.Obj, scope: Scope, _: bool) -> Val:
    if not n.items:
        return Val("map()", T.MapType(T.StringType(), T.StringType()), True)
    items = [(k, compile(v, scope)) for k, v in n.items]
    return typed(scope, "named_struct(" + ", ".join(f"{text(k)}, {v.sql}" for k, v in items) + ")", all(v.literal for _, v in items))


def _un(n: A.Un, scope: Scope, _: bool) -> Val:
    v = compile(n.arg, scope)
    if n.op == "!":
        return Val(f"(NOT {truthy(v)})", T.BooleanType(), v.literal)
    return Val(f"(-{v.sql})", v.type, v.literal) if n.op == "-" else v


def _bin(n: A.Bin, scope: Scope, pushable: bool) -> Val:
    op = n.op
    if op in ("AND", "OR"):
        a, b = compile(n.left, scope, pushable), compile(n.right, scope, pushable)
        if a.family == b.family == "bool":
            return Val(f"({a.sql} {op} {b.sql})" if pushable else f"({truthy(a)} {op} {truthy(b)})", T.BooleanType())
        if a.type == b.type and not pushable:
            first, other = (b, a) if op == "AND" else (a, b)
            return Val(f"if({truthy(a)}, {first.sql}, {other.sql})", a.type)
        return Val(f"({truthy(a)} {op} {truthy(b)})", T.BooleanType())
    if op in ("INSIDE", "NOTINSIDE") and isinstance(n.right, A.Select):
        return scope.top.hooks.inside(n.left, n.right, scope, op == "NOTINSIDE")
    if op == "@@":
        return scope.top.hooks.matches(n, scope)
    if op == "KNN":
        return scope.top.hooks.nearest(n, scope)
    if op in ("INSIDE", "CONTAINS", "NOTINSIDE", "CONTAINSNOT"):
        needle, hay = (n.left, n.right) if op in ("INSIDE", "NOTINSIDE") else (n.right, n.left)
        sql = member(needle, hay, scope)
        return Val(f"(NOT {sql})" if "NOT" in op else sql, T.BooleanType())
    a, b = compile(n.left, scope), compile(n.right, scope)
    lit_ = a.literal and b.literal
    if op in ("=", "=="):
        return Val(equal(a, b), T.BooleanType(), lit_)
    if op == "!=":
        return Val(f"(NOT {equal(a, b)})", T.BooleanType(), lit_)
    if op in ("<", "<=", ">", ">="):
        return Val(compare(op, a, b, pushable), T.BooleanType(), lit_)
    if op in ("*=", "?="):
        if a.family != "array":
            return Val(equal(a, b), T.BooleanType(), lit_)
        return Val(f"coalesce({'forall' if op == '*=' else 'exists'}({a.sql}, x -> x <=> {b.sql}), false)", T.BooleanType(), lit_)
    if op == "??":
        return typed(scope, f"coalesce({a.sql}, {b.sql})", lit_)
    if op == "?:":
        return typed(scope, f"if({truthy(a)}, {a.sql}, {b.sql})", lit_)
    many = {"CONTAINSALL": "forall({b}, x -> array_contains({a}, x))", "CONTAINSANY": "exists({b}, x -> array_contains({a}, x))", "CONTAINSNONE": "not exists({b}, x -> array_contains({a}, x))", "ALLINSIDE": "forall({a}, x -> array_contains({b}, x))", "ANYINSIDE": "exists({a}, x -> array_contains({b}, x))", "NONEINSIDE": "not exists({a}, x -> array_contains({b}, x))"}
    if op in many:
        if a.family == "string" and b.family == "array":
            name = {"CONTAINSALL": "forall", "CONTAINSANY": "exists"}.get(op, "not exists")
            return Val(f"coalesce({name}({b.sql}, x -> contains({a.sql}, x)), false)", T.BooleanType())
        return Val(f"coalesce({many[op].format(a=a.sql, b=b.sql)}, false)", T.BooleanType(), lit_)
    if op in ("OUTSIDE", "INTERSECTS"):
        from omniframe.functions import geometry

        return Val(geometry.relation(op, a, b, scope), T.BooleanType())
    return typed(scope, arithmetic(op, a, b), lit_)


def member(needle: A.Node, hay: A.Node, scope: Scope) -> str:
    v = compile(needle, scope)
    if isinstance(hay, A.Range):
        parts = []
        if hay.begin is not None:
            parts.append(compare(">" if hay.skip else ">=", v, compile(hay.begin, scope)))
        if hay.end is not None:
            parts.append(compare("<=" if hay.inclusive else "<", v, compile(hay.end, scope)))
        return f"({' AND '.join(parts) or 'true'})"
    if isinstance(hay, A.Array) and hay.items and not v.literal:
        items = [compile(i, scope) for i in hay.items]
        if all(i.literal and i.family == v.family for i in items):
            return f"coalesce({v.sql} IN ({', '.join(i.sql for i in items)}), false)"
    h = compile(hay, scope)
    if h.family == "string":
        return f"coalesce(contains({h.sql}, {v.sql}), false)"
    if h.family == "array":
        if h.sql == "array()":
            return "false"
        return f"coalesce(array_contains({h.sql}, {v.sql}), false)"
    if isinstance(h.type, T.MapType):
        return f"coalesce(map_contains_key({h.sql}, {v.sql}), false)"
    if isinstance(h.type, T.StructType):
        if {"x", "y"} <= {f.name for f in h.type.fields} or "coordinates" in {f.name for f in h.type.fields}:
            from omniframe.functions import geometry

            return geometry.relation("CONTAINS", h, v, scope)
        names = ", ".join(text(f.name) for f in h.type.fields)
        return f"coalesce({v.sql} IN ({names}), false)"
    return "false"


def _cast(n: A.Cast, scope: Scope, _: bool) -> Val:
    v = compile(n.arg, scope)
    kind = re.sub(r"^option<(.*)>$", r"\1", n.kind)
    if kind.startswith("array<"):
        inner = KINDS.get(kind[6:-1].split(",")[0], "string")
        return typed(scope, f"cast({v.sql} as array<{inner}>)", v.literal)
    if kind == "set" or kind.startswith("set<"):
        return typed(scope, f"array_sort(array_distinct({v.sql}))", v.literal)
    if kind == "duration":
        return duration_of(v, scope)
    if kind == "array":
        return compile(n.arg, scope) if v.family == "array" else sequence_of(n.arg, scope) if isinstance(n.arg, A.Range) else typed(scope, f"array({v.sql})")
    if kind.startswith("record"):
        return v
    if kind not in KINDS:
        raise QueryError(f"no cast to {n.kind}")
    if kind == "bool" and v.family == "number":
        return Val(truthy(v), T.BooleanType(), v.literal)
    return typed(scope, f"cast({v.sql} as {KINDS[kind]})", v.literal)


def duration_of(v: Val, scope: Scope) -> Val:
    """A duration from its text, such as 1h30m."""
    if v.family == "duration":
        return v
    part = lambda unit: f"coalesce(try_cast(regexp_extract({v.sql}, '([0-9]+){unit}(?![a-z])', 1) as bigint), 0)"
    secs = f"cast({part('s')} + {part('ms')} / 1000D + {part('us')} / 1000000D as decimal(18,6))"
    return Val(f"make_dt_interval(cast({part('d')} + 7 * {part('w')} + 365 * {part('y')} as int), cast({part('h')} as int), cast({part('m')} as int), {secs})", T.DayTimeIntervalType(), v.literal)


def _if(n: A.If, scope: Scope, _: bool) -> Val:
    parts = [f"WHEN {truthy(compile(c, scope))} THEN {compile(b, scope).sql}" for c, b in n.branches]
    other = f" ELSE {compile(n.other, scope).sql}" if n.other is not None else ""
    return typed(scope, f"CASE {' '.join(parts)}{other} END")


def _block(n: A.Block, scope: Scope, _: bool) -> Val:
    """A block whose statements are bindings and one value."""
    inner = scope
    out = lit(None)
    for s in n.body:
        if isinstance(s, A.Statement) and s.kind == "LET":
            inner = inner.inner(**{s.clauses["name"]: compile(s.clauses["value"], inner)})
        elif isinstance(s, A.Statement) and s.kind == "RETURN":
            return compile(s.clauses["value"], inner)
        elif isinstance(s, A.Statement) and s.kind == "IF":
            out = compile(s.clauses["if"], inner)
        else:
            raise QueryError("only bindings and values can stand in a block inside an expression")
    return out


def _select(n: A.Select, scope: Scope, _: bool) -> Val:
    return scope.top.hooks.subquery(n, scope)


def _statement(n: A.Statement, scope: Scope, _: bool) -> Val:
    if n.kind == "RETURN":
        return compile(n.clauses["value"], scope)
    if n.kind == "IF":
        return compile(n.clauses["if"], scope)
    raise QueryError(f"{n.kind} cannot stand inside an expression")


def _closure(n: A.Closure, scope: Scope, _: bool) -> Val:
    raise QueryError("a closure can only be an argument")


def bind(closure: A.Node, scope: Scope, kinds: list[T.DataType]) -> tuple[list[str], Val]:
    """A lambda's variables and its body over parameters of these types."""
    names, given = [], {}
    for k, p in zip(kinds, closure.params):
        _count[0] += 1
        name = f"_v{_count[0]}"
        names.append(name)
        given[p] = Val(name, k)
    return names, compile(closure.body, scope.inner(**given))


def arrow(names: list[str], body: str) -> str:
    return f"{names[0]} -> {body}" if len(names) == 1 else f"({', '.join(names)}) -> {body}"


def element(v: Val) -> T.DataType:
    if not isinstance(v.type, T.ArrayType):
        raise QueryError(f"an array is wanted, not {v.type.simpleString()}")
    return v.type.elementType


def call_sql(name: str, args: list[Val]) -> str:
    t = SCALAR[name]
    if isinstance(t, dict):
        if len(args) not in t:
            raise QueryError(f"{name} does not take {len(args)} arguments")
        t = t[len(args)]
    if "{*s}" in t:
        return t.replace("{*s}", ", ".join(f"string({a.sql})" for a in args))
    if "{*}" in t:
        return t.replace("{*}", ", ".join(a.sql for a in args))
    try:
        return t.format(*[a.sql for a in args])
    except IndexError:
        raise QueryError(f"{name} wants more than {len(args)} arguments") from None


def _call(n: A.Call, scope: Scope, _: bool) -> Val:
    from omniframe.functions import special

    name = n.name
    if name.startswith("$"):
        target = scope.locals.get(name[1:], scope.params.get(name[1:]))
        if not isinstance(target, A.Closure):
            raise QueryError(f"{name} is not a function")
        return compile(target.body, scope.inner(**{p: compile(a, scope) for p, a in zip(target.params, n.args)}))
    if name.startswith("fn::"):
        f = scope.catalog.functions.get(name)
        if f is None:
            raise QueryError(f"there is no function {name}")
        return compile(f["body"], scope.inner(**{p: compile(a, scope) for (p, _k), a in zip(f["params"], n.args)}))
    if name in special.SPECIAL:
        return special.SPECIAL[name](n, scope)
    if not n.args and name in CONSTANTS:
        return typed(scope, CONSTANTS[name], True)
    if name in SCALAR:
        args = [sequence_of(a, scope) if isinstance(a, A.Range) and a.begin is not None and a.end is not None and not name.startswith("rand") else compile(a, scope) for a in n.args]
        return typed(scope, call_sql(name, args), bool(args) and all(a.literal for a in args) and not name.startswith("rand"))
    raise QueryError(f"there is no function {name}")


def _idiom(n: A.Idiom, scope: Scope, _: bool) -> Val:
    parts = list(n.parts)
    if n.start is not None:
        v = compile(n.start, scope) if not (isinstance(n.start, A.Param) and n.start.name == "parent") else None
        if v is None:
            return scope.top.hooks.parent(parts, scope)
    elif parts and parts[0].kind == "field":
        name = parts.pop(0).value
        v = column(name, scope)
    elif parts and parts[0].kind in ("graph", "recurse"):
        v = None
    elif parts and parts[0].kind == "all":
        parts.pop(0)
        v = this(scope)
    else:
        v = this(scope)
    if parts and parts[0].kind in ("graph", "recurse"):
        return scope.top.hooks.graph(v, parts, scope)
    for k, p in enumerate(parts):
        if p.kind in ("graph", "recurse"):
            return scope.top.hooks.graph(v, parts[k:], scope)
        v = part(v, p, scope)
    return v


def column(name: str, scope: Scope) -> Val:
    if name in scope.locals:
        return scope.locals[name]
    if scope.this is not None and isinstance(scope.this.type, T.StructType) and name in scope.this.type.names:
        return Val(f"{scope.this.sql}.{quote(name)}", scope.this.type[name].dataType)
    df = scope.top.df
    if df is not None and name in df.columns:
        t = scope.catalog.tables.get(scope.top.table or "")
        return Val(quote(name), df.schema[name].dataType, link=t.links.get(name) if t else None)
    if name in scope.aliases:
        return scope.aliases[name]
    t = scope.catalog.tables.get(scope.top.table or "")
    if name == "id" and t is not None and t.key and df is not None and t.key in df.columns:
        return Val(quote(t.key), df.schema[t.key].dataType, link=t.name)
    if t is not None and name in t.info.get("computed", {}):
        return compile(t.info["computed"][name], scope)
    return lit(None)


def part(v: Val, p: A.Part, scope: Scope) -> Val:
    """One step of a path."""
    if p.kind == "field":
        if v.link and not isinstance(v.type, T.StructType):
            return scope.top.hooks.follow(v, p.value, scope)
        if isinstance(v.type, T.StructType):
            if p.value not in v.type.names:
                return lit(None)
            return Val(f"{v.sql}.{quote(p.value)}", v.type[p.value].dataType)
        if isinstance(v.type, T.MapType):
            return Val(f"try_element_at({v.sql}, {text(p.value)})", v.type.valueType)
        if isinstance(v.type, T.ArrayType):
            return mapped(v, lambda x, s: part(x, p, s), scope)
        if isinstance(v.type, T.VariantType):
            return Val(f"try_variant_get({v.sql}, {text('$.' + p.value)})", T.VariantType())
        if v.family == "string":  # text that holds an object
            return Val(f"get_json_object({v.sql}, {text('$.' + p.value)})", T.StringType())
        return lit(None)
    if p.kind == "index":
        i = p.value
        if isinstance(i, A.Range):
            return slice_of(v, i, scope)
        k = compile(i, scope)
        if isinstance(v.type, T.MapType) or isinstance(v.type, T.StructType) and k.family == "string":
            return part(v, A.Part("field", i.value), scope)
        return Val(f"try_element_at({v.sql}, cast(if({k.sql} >= 0, {k.sql} + 1, {k.sql}) as int))", element(v))
    if p.kind == "all":
        if isinstance(v.type, T.MapType):
            return typed(scope, f"map_values({v.sql})")
        return v
    if p.kind == "last":
        return Val(f"try_element_at({v.sql}, -1)", element(v))
    if p.kind == "flatten":
        return typed(scope, f"flatten({v.sql})") if isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.ArrayType) else v
    if p.kind == "optional":
        return v
    if p.kind == "where":
        _count[0] += 1
        x = Val(f"_v{_count[0]}", element(v))
        inner = scope.inner(this_=x)
        inner.this = x
        return Val(f"filter({v.sql}, {x.sql} -> {truthy(compile(p.value, inner))})", v.type)
    if p.kind == "destructure":
        def build(x: Val, s: Scope) -> Val:
            if x.link and not isinstance(x.type, T.StructType):
                items = [(name, scope.top.hooks.follow(x, name, s) if sub is None else part(x, A.Part("field", name), s)) for name, sub in p.value]
            else:
                inner = s.inner()
                inner.this = x
                items = [(name, part(x, A.Part("field", name), s) if sub is None else compile(sub, inner)) for name, sub in p.value]
            return typed(s, "named_struct(" + ", ".join(f"{text(k)}, {i.sql}" for k, i in items) + ")")

        return mapped(v, build, scope) if isinstance(v.type, T.ArrayType) else build(v, scope)
    if p.kind == "method":
        return method(v, p.value, p.args, scope)
    raise QueryError(f"no path step {p.kind}")


def slice_of(v: Val, r: A.Range, scope: Scope) -> Val:
    lo = compile(r.begin, scope).sql if r.begin is not None else "0"
    a = f"({lo} + {1 + r.skip})"
    if r.end is None:
        n = f"size({v.sql})"
    else:
        hi = compile(r.end, scope).sql
        n = f"greatest({hi} + {int(r.inclusive)} - {a} + 1, 0)"
    return Val(f"slice({v.sql}, cast({a} as int), cast({n} as int))", v.type)


def mapped(v: Val, step: Callable[[Val, Scope], Val], scope: Scope) -> Val:
    """A step taken for every element."""
    _count[0] += 1
    x = Val(f"_v{_count[0]}", element(v), link=v.link)
    body = step(x, scope.inner(**{x.sql: x}))
    return Val(f"transform({v.sql}, {x.sql} -> {body.sql})", T.ArrayType(body.type), link=body.link)


#: Receivers' families to the namespaces that are searched for a method.
SPACES = {"array": ("array", "set", "vector", "math"), "string": ("string", "parse", "record", "type"), "number": ("math",), "datetime": ("time",), "duration": ("duration",), "object": ("object", "geo"), "bytes": ("bytes",), "bool": ()}


def method(v: Val, name: str, args: list[A.Node], scope: Scope) -> Val:
    from omniframe.functions import special

    _count[0] += 1
    hold = f"recv{_count[0]}"
    node = lambda f: A.Call(f, [A.Param(hold), *args])
    inner = scope.inner(**{hold: v})
    if name == "chain":
        return compile(args[0].body, scope.inner(**{args[0].params[0]: v}))
    spaces = (*SPACES.get(v.family, ()), "type", "value")
    plain = name.replace("_", "::", 1)
    for space in spaces:
        for f in (f"{space}::{name}", f"{space}::{plain}", f"{space}::{name.replace('_', '::')}"):
            if f in SCALAR or f in special.SPECIAL:
                return compile(node(f), inner)
    if name.startswith("to_"):
        return compile(A.Cast(name[3:], A.Param(hold)), inner)
    if name == "repeat":
        return compile(node("array::repeat"), inner)
    if isinstance(v.type, T.StructType) and name in v.type.names:
        return part(v, A.Part("field", name), scope)
    raise QueryError(f"no method {name} on {v.type.simpleString()}")
