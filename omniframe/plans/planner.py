"""SELECT to a DataFrame: clauses in the language's order, links and graph walks as joins."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omniframe.operators import fulltext, graph
from omniframe.plans import ast as A
from omniframe.plans import compiler as C
from omniframe.plans.catalog import Catalog
from omniframe.plans.compiler import QueryError, Scope, compile, condition, lit, typed
from omniframe.plans.values import Val, quote, truthy

AGGREGATES = frozenset("count math::sum math::mean math::min math::max math::stddev math::variance math::median time::min time::max array::group array::distinct array::join".split())
METRICS = {"euclidean": "vector::distance::euclidean", "manhattan": "vector::distance::manhattan", "chebyshev": "vector::distance::chebyshev", "hamming": "vector::distance::hamming", "minkowski": "vector::distance::minkowski", "cosine": "vector::distance::cosine", "jaccard": "vector::similarity::jaccard", "pearson": "vector::similarity::pearson"}


def conjuncts(n: A.Node | None) -> list[A.Node]:
    if n is None:
        return []
    if isinstance(n, A.Bin) and n.op == "AND":
        return conjuncts(n.left) + conjuncts(n.right)
    return [n]


def default_name(n: A.Node) -> str:
    if isinstance(n, A.Idiom):
        names = [p.value for p in n.parts if p.kind in ("field", "method")]
        if names:
            return str(names[-1])
        for p in reversed(n.parts):
            if p.kind == "graph":
                return p.value.alias or p.value.tables[-1]
    if isinstance(n, A.Call):
        return n.name
    if isinstance(n, A.Param):
        return n.name
    return "value"


class Planner:
    """One frame of rows while its clauses are applied; also the compiler's hooks."""

    def __init__(self, catalog: Catalog, params: dict[str, Any] | None = None, outer: Planner | None = None) -> None:
        self.catalog, self.params, self.outer = catalog, dict(params or {}), outer
        self.scope = Scope(catalog, None, None, self.params, hooks=self)
        self.n = 0
        self.joined: dict[tuple, str] = {}
        self.terms: dict[str, tuple[str, list[str]]] = {}
        self.correlated: list[tuple[str, str]] = []
        self.pending: list[tuple[Val, str]] = []

    # frames

    @property
    def df(self) -> DataFrame:
        return self.scope.df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self.scope.df = df

    def fresh(self, what: str) -> str:
        root = self
        while root.outer is not None:
            root = root.outer
        root.n += 1
        return f"_{what}{root.n}"

    def source(self, n: A.Node) -> tuple[DataFrame, str | None]:
        """A FROM item's rows and table."""
        c = self.catalog
        if isinstance(n, A.Idiom) and n.start is None and len(n.parts) == 1 and n.parts[0].kind == "field":
            name = n.parts[0].value
            return self.table(name), name
        if isinstance(n, A.RecordId):
            t = c.table(n.table)
            df = self.table(n.table)
            if isinstance(n.key, A.Range):
                r = n.key
                for side, op in ((r.begin, ">" if r.skip else ">="), (r.end, "<=" if r.inclusive else "<")):
                    if side is not None:
                        v = compile(side if t.info.get("plain_key") else A.RecordId(n.table, side), self.scope)
                        df = df.filter(f"{quote(t.key)} {op} {v.sql}")
                return df, n.table
            return df.filter(f"{quote(t.key)} = {compile(n, self.scope).sql}"), n.table
        if isinstance(n, A.Select):
            inner = Planner(c, self.params)
            return inner.select(n), None
        if isinstance(n, A.Param):
            v = self.params.get(n.name)
            if isinstance(v, DataFrame):
                return v, None
            if isinstance(v, str) and v in c.tables:
                return self.table(v), v
        if isinstance(n, A.Mock):
            return c.spark.range(n.begin, n.end + 1).select(F.concat(F.lit(n.table + ":"), "id").alias("id")), n.table
        if isinstance(n, A.Call) and n.name == "type::table":
            return self.source(A.Idiom(None, [A.Part("field", n.args[0].value)]))
        if isinstance(n, A.Lit) and n.value is None:
            return c.spark.range(0).select(F.lit(None).alias("value")), None
        v = C.sequence_of(n, self.scope) if isinstance(n, A.Range) else compile(n, self.scope)
        one = c.spark.range(1)
        if v.family == "array":
            rows = one.selectExpr(f"explode({v.sql}) AS value")
        else:
            rows = one.selectExpr(f"{v.sql} AS value")
        kind = rows.schema[0].dataType
        return (rows.select("value.*") if isinstance(kind, T.StructType) else rows), None

    def table(self, name: str) -> DataFrame:
        t = self.catalog.table(name)
        df = t.df()
        if self.version is not None and t.versions:
            kept = [d for at, d in t.versions if at <= self.version]
            df = kept[-1] if kept else t.versions[0][1].limit(0)
        return df

    version: float | None = None

    def start(self, s: A.Select) -> None:
        frames = [self.source(n) for n in s.sources]
        df, table = frames[0]
        for other, name in frames[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
            table = table if table == name else None
        self.df, self.scope.table = df, table

    # SELECT

    def select(self, s: A.Select) -> DataFrame:
        if s.version is not None:
            self.version = constant(s.version, self.catalog, self.params).timestamp()
        self.start(s)
        self.where(s.where)
        outs = self.split_columns(s)
        for n in s.split:
            self.split(n)
        if s.group is not None:
            return self.finish(self.grouped(s), s)
        out = self.projected(s, outs)
        return self.finish(out, s)

    def split_columns(self, s: A.Select) -> dict[str, Val]:
        """Aliased columns that SPLIT needs before the projection."""
        named = {c.alias: c.expr for c in s.columns if c.alias and c.expr is not None}
        for n in s.split:
            name = default_name(n)
            if name in named and name not in self.df.columns:
                self.df = self.with_column(name, compile(named[name], self.scope))
        return {}

    def with_column(self, name: str, v: Val) -> DataFrame:
        return self.df.withColumn(name, F.expr(v.sql))

    def where(self, n: A.Node | None) -> None:
        parts = conjuncts(n)
        late = [p for p in parts if isinstance(p, A.Bin) and p.op == "KNN"]
        text_parts = [p for p in parts if contains_match(p)]
        for p in text_parts:  # statistics are those of the whole table
            self.prepare_matches(p)
        for p in parts:
            if p in late or self.parent_equality(p) or self.semi(p):
                continue
            sql = condition(p, self.scope)
            self.df = self.df.filter(sql)
        for p in late:
            self.rank(p)

    def semi(self, n: A.Node) -> bool:
        """Conditions that are semi or anti joins: an edge exists, a key is in a subquery."""
        if isinstance(n, A.Bin) and n.op in (">", "=") and isinstance(n.left, A.Call) and n.left.name == "count" and len(n.left.args) == 1 and isinstance(n.right, A.Lit) and n.right.value == 0:
            arg = n.left.args[0]
            if isinstance(arg, A.Idiom) and arg.start is None and arg.parts and all(p.kind == "graph" for p in arg.parts):
                rows = self.walk(arg.parts)[0].select("_src").distinct()
                key = self.key()
                self.df = self.df.join(rows, F.col(key) == F.col("_src"), "left_semi" if n.op == ">" else "left_anti")
                return True
        if isinstance(n, A.Bin) and n.op in ("INSIDE", "NOTINSIDE") and isinstance(n.right, A.Select):
            inner = Planner(self.catalog, self.params).select(n.right)
            v = compile(n.left, self.scope)
            name = self.fresh("in")
            rows = inner.select(F.col(quote(inner.columns[0])).alias(name)).distinct()
            self.df = self.df.join(rows, F.expr(v.sql).eqNullSafe(F.col(name)), "left_semi" if n.op == "INSIDE" else "left_anti")
            return True
        return False

    def parent_equality(self, n: A.Node) -> bool:
        """inner = $parent.outer, of a correlated subquery, becomes a join key."""
        if self.outer is None or not isinstance(n, A.Bin) or n.op not in ("=", "=="):
            return False
        for inner, outer in ((n.left, n.right), (n.right, n.left)):
            if is_parent(outer) and not mentions_parent(inner):
                o = compile(A.Idiom(None, outer.parts), self.outer.scope)
                self.correlated.append((compile(inner, self.scope).sql, o.sql))
                return True
        return False

    def split(self, n: A.Node) -> None:
        name = default_name(n)
        v = compile(n, self.scope)
        if v.family != "array":
            return
        items = f"if(size({v.sql}) > 0, transform({v.sql}, x -> named_struct('v', x)), array(named_struct('v', CAST(NULL AS {C.element(v).simpleString()}))))"
        rest = [quote(c) for c in self.df.columns if c != name]
        self.df = self.df.selectExpr(*rest, f"explode(coalesce({items}, array(named_struct('v', CAST(NULL AS {C.element(v).simpleString()}))))) AS _s").selectExpr(*rest, f"_s.v AS {quote(name)}")

    def projected(self, s: A.Select, outs: dict[str, Val]) -> DataFrame:
        cols: list[tuple[str, Val]] = []
        star = False
        for c in s.columns:
            if c.expr is None:
                star = True
            elif isinstance(c.expr, A.Call) and c.expr.name == "type::fields":
                for a in c.expr.args[0].items:
                    cols.append((a.value, compile(A.Call("type::field", [a]), self.scope)))
            else:
                name = c.alias or default_name(c.expr)
                v = Val(quote(name), self.df.schema[name].dataType) if c.alias in [default_name(x) for x in s.split] and name in self.df.columns else compile(c.expr, self.scope)
                cols.append((name, v))
        self.scope.aliases = {n: v for n, v in cols}
        keys = [self.order_column(o) for o in s.order]
        visible = [c for c in self.df.columns if not c.startswith("_")]
        final = ([(c, quote(c)) for c in visible if c not in {n for n, _ in cols}] if star else []) + [(n, v.sql) for n, v in cols]
        df = self.df
        if keys:
            df = df.orderBy(*keys)
        df = limited(df, s, self.catalog, self.params)
        out = df.selectExpr(*[f"{sql} AS {quote(n)}" for n, sql in final]) if final else df.limit(0)
        return omit(out, s.omit)

    def order_column(self, o: A.Order) -> F.Column:
        if o.expr is None:
            return F.rand()
        v = None
        if isinstance(o.expr, A.Idiom) and o.expr.start is None and len(o.expr.parts) == 1:
            v = self.scope.aliases.get(o.expr.parts[0].value)
        v = v or compile(o.expr, self.scope)
        sql = v.sql
        if o.collate or o.numeric:
            from omniframe.functions.special import sort_key

            sql = sort_key(sql, o.collate, o.numeric)
        return F.expr(sql).desc() if o.descending else F.expr(sql).asc()

    # GROUP

    def grouped(self, s: A.Select) -> DataFrame:
        named = {c.alias: c.expr for c in s.columns if c.alias and c.expr is not None}
        if any(c.expr is None for c in s.columns):
            raise QueryError("* cannot be selected with GROUP")
        keys: list[tuple[str, Val]] = []
        key_nodes: dict[str, str] = {}
        for n in s.group:
            name = default_name(n)
            node = named.get(name, n) if not (name in self.df.columns and name not in named) else n
            if name in self.df.columns and name in [default_name(x) for x in s.split]:
                node = n
            keys.append((name, compile(node, self.scope)))
            key_nodes[repr(node)] = name
            key_nodes[repr(n)] = name
        order = [c for c in (self.catalog.tables[self.scope.table].sort if self.scope.table in self.catalog.tables else []) if c in self.df.columns]
        aggs: list[tuple[str, Val]] = []
        posts: list[tuple[str, A.Node]] = []
        for c in s.columns:
            name = c.alias or default_name(c.expr)
            if repr(c.expr) in key_nodes:
                posts.append((name, A.Idiom(None, [A.Part("field", "_k_" + key_nodes[repr(c.expr)])])))
            else:
                posts.append((name, self.lift(c.expr, aggs, order, not s.group, key_nodes)))
        pre = self.df.selectExpr("*", *[f"{v.sql} AS {quote('_k_' + n)}" for n, v in keys])
        groups = pre.groupBy(*[F.col(quote("_k_" + n)) for n, _ in keys])
        done = groups.agg(*[F.expr(v.sql).alias(n) for n, v in aggs]) if aggs else pre.select(*[quote("_k_" + n) for n, _ in keys]).distinct()
        inner = Planner(self.catalog, self.params, self.outer)
        inner.df = done
        inner.correlated = self.correlated
        outs = [(name, compile(node, inner.scope)) for name, node in posts]
        inner.scope.aliases = {n: v for n, v in outs} | {n: Val(quote("_k_" + n), done.schema["_k_" + n].dataType) for n, _ in keys}
        if s.order:
            done = done.orderBy(*[inner.order_column(o) for o in s.order])
        done = limited(done, s, self.catalog, self.params)
        return omit(done.selectExpr(*[f"{v.sql} AS {quote(n)}" for n, v in outs]), s.omit)

    def lift(self, n: A.Node, aggs: list[tuple[str, Val]], order: list[str], whole: bool, keys: dict[str, str]) -> A.Node:
        """The expression over groups: aggregates become columns, bare fields arrays of a group's values."""

        def column(sql: str) -> A.Node:
            for name, v in aggs:
                if v.sql == sql:
                    return A.Idiom(None, [A.Part("field", name)])
            name = f"_a{len(aggs)}"
            aggs.append((name, Val(sql, T.NullType())))
            return A.Idiom(None, [A.Part("field", name)])

        def collected(sql: str) -> str:
            keys_ = ", ".join(quote(c) for c in order)
            row = f"named_struct('o', struct({keys_ or '0'}), 'x', {sql})"
            return f"transform({'array_sort' if order else ''}(collect_list({row})), s -> s.x)"

        if repr(n) in keys:
            return A.Idiom(None, [A.Part("field", "_k_" + keys[repr(n)])])
        if isinstance(n, A.Call) and n.name in AGGREGATES and not (n.args and has_aggregate(n.args[0])):
            if n.name == "count":
                if not n.args:
                    return column("count(1)")
                v = compile(n.args[0], self.scope)
                if v.family == "array":
                    v = compile(n, self.scope)
                    return column(f"sum({v.sql})")
                return column(f"count_if({truthy(v)})")
            v = compile(n.args[0], self.scope)
            what = n.name.split("::")[1]
            if v.family != "array" or n.name.startswith("array"):
                if n.name == "math::sum":
                    return column(f"coalesce(sum({v.sql}), 0)")
                if n.name == "math::mean":
                    return column(f"coalesce(avg({v.sql}), double('NaN'))")
                if n.name in ("math::min", "math::max"):
                    empty = "Infinity" if what == "min" else "-Infinity"
                    return column(f"coalesce({what}({v.sql}), double('{empty}'))" if whole and v.type == T.DoubleType() else f"{what}({v.sql})")
                if n.name == "math::stddev":
                    return column(f"coalesce(stddev_samp({v.sql}), 0D)")
                if n.name == "math::variance":
                    return column(f"coalesce(var_samp({v.sql}), 0D)")
                if n.name == "math::median":
                    return column(f"median({v.sql})")
                if n.name in ("time::min", "time::max"):
                    return column(f"{what}({v.sql})")
                if n.name == "array::group":
                    return column(f"flatten({collected(v.sql)})" if v.family == "array" else collected(v.sql))
                if n.name == "array::distinct":
                    return column(f"array_distinct({collected(v.sql)})")
                if n.name == "array::join":
                    return column(f"array_join({collected(f'string({v.sql})')}, {compile(n.args[1], self.scope).sql})")
        if isinstance(n, A.Idiom) and n.start is None and n.parts and n.parts[0].kind in ("field", "graph"):
            return column(collected(compile(n, self.scope).sql))
        if isinstance(n, A.Call):
            return A.Call(n.name, [a if isinstance(a, A.Closure) else self.lift(a, aggs, order, whole, keys) for a in n.args])
        if isinstance(n, A.Bin):
            return A.Bin(n.op, self.lift(n.left, aggs, order, whole, keys), self.lift(n.right, aggs, order, whole, keys), n.extra)
        if isinstance(n, A.Un):
            return A.Un(n.op, self.lift(n.arg, aggs, order, whole, keys))
        if isinstance(n, A.Cast):
            return A.Cast(n.kind, self.lift(n.arg, aggs, order, whole, keys))
        if isinstance(n, A.Array):
            return A.Array([self.lift(i, aggs, order, whole, keys) for i in n.items])
        if isinstance(n, A.Obj):
            return A.Obj([(k, self.lift(v, aggs, order, whole, keys)) for k, v in n.items])
        if isinstance(n, A.If):
            return A.If([(self.lift(c, aggs, order, whole, keys), self.lift(b, aggs, order, whole, keys)) for c, b in n.branches], self.lift(n.other, aggs, order, whole, keys) if n.other is not None else None)
        if isinstance(n, A.Idiom) and n.start is not None:
            return A.Idiom(self.lift(n.start, aggs, order, whole, keys), n.parts)
        return n

    def finish(self, out: DataFrame, s: A.Select) -> DataFrame:
        for n in s.fetch:
            out = self.fetch(out, n)
        if s.value:
            first = out.columns[0]
            out = out.select(F.col(quote(first)))
        if s.only:
            if len(out.limit(2).take(2)) > 1:
                raise QueryError("ONLY wants a single row")
        return out

    def fetch(self, out: DataFrame, n: A.Node) -> DataFrame:
        """A column of record keys replaced by the records."""
        name = default_name(n)
        if name not in out.columns:
            return out
        t = self.catalog.tables.get(self.scope.table or "")
        target = (t.links.get(name) if t else None) or self.guess(out, name)
        if target is None:
            return out
        right = self.catalog.table(target)
        rows = right.df()
        key, rec = self.fresh("fk"), self.fresh("fr")
        side = rows.select(F.col(right.key).alias(key), F.struct(*rows.columns).alias(rec))
        if isinstance(out.schema[name].dataType, T.ArrayType):
            # each distinct array is looked up once and joined back by its own value
            number = self.fresh("row")
            each = out.select(F.col(name).alias(number)).distinct().select(number, F.posexplode(number).alias("_pos", "_item")).join(side, F.col("_item") == F.col(key), "left")
            each = each.groupBy(number).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", rec))), lambda x: x[rec]).alias(rec))
            both = out.join(each, F.col(name).eqNullSafe(F.col(number)), "left").drop(number)
        else:
            both = out.join(side, F.col(name) == F.col(key), "left")
        return both.select(*[F.col(rec).alias(c) if c == name else F.col(quote(c)) for c in out.columns])

    def guess(self, out: DataFrame, name: str) -> str | None:
        """The table that a column of record ids names, from the declared fields."""
        t = self.catalog.tables.get(self.scope.table or "")
        kind = str((t.info.get("fields", {}).get(name, {}) if t else {}).get("type", ""))
        return kind.split("record<")[1].split(">")[0] if "record<" in kind else None

    # hooks of the compiler

    def key(self) -> str:
        t = self.catalog.tables.get(self.scope.table or "")
        if t is None or not t.key:
            raise QueryError("the rows have no record id to start from")
        return t.key

    def follow(self, v: Val, field: str, scope: Scope) -> Val:
        """A field of the record that a key points to: a left join, made once a path."""
        right = self.catalog.table(v.link)
        if v.family == "array":
            return self.follow_array(v, field, right)
        mark = ("link", v.sql, v.link)
        rows = right.df()
        if mark not in self.joined:
            prefix = self.fresh("l") + "_"
            side = rows.select(*[F.col(quote(c)).alias(prefix + c) for c in rows.columns])
            self.df = self.df.join(side, F.expr(v.sql) == F.col(quote(prefix + right.key)), "left")
            self.joined[mark] = prefix
        prefix = self.joined[mark]
        if field == "id":
            field = right.key
        if field not in rows.columns:
            return lit(None)
        return Val(quote(prefix + field), rows.schema[field].dataType, link=right.links.get(field))

    def follow_array(self, v: Val, field: str, right: Any) -> Val:
        rows = right.df()
        number, out, items = self.fresh("n"), self.fresh("f"), self.fresh("i")
        self.df = self.df.withColumn(items, F.expr(v.sql))
        side = rows.select(F.col(right.key).alias("_rk"), F.col(quote(field)).alias("_rv"))
        # each distinct array is looked up once and joined back by its own value
        each = self.df.select(F.col(items).alias(number)).distinct().select(number, F.posexplode(number).alias("_p", "_i")).join(side, F.col("_i") == F.col("_rk"), "left")
        each = each.groupBy(number).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_rv"))), lambda x: x["_rv"]).alias(out))
        self.df = self.df.join(each, F.col(items).eqNullSafe(F.col(number)), "left")
        return Val(f"coalesce({out}, array())", T.ArrayType(rows.schema[field].dataType), link=right.links.get(field))

    def walk(self, parts: list[A.Part], fields: bool = False, counted: bool = False) -> tuple[DataFrame, str | None, str | None]:
        """Rows (_src, _ord, _at and the last table's columns) of a chain of graph steps; the last table; its kind.

        Steps that name several tables, or any (``?``), are walked along every way through them and
        united in the order of the tables; the last table is None if the ways end at different ones.
        A walk that is only counted meets each later edge table after its nodes, so that no walked pairs are shuffled for them.
        """
        for p in parts[:-1]:
            if p.value.order or p.value.limit is not None or p.value.start is not None:
                raise QueryError("ORDER, LIMIT and START can only stand in a walk's last step")
        ways = self.ways(parts, fields)
        if not ways:
            raise QueryError(f"no table fits {parts[0].value.tables}")
        found = [self.walk_way(parts, names, len(ways) > 1, counted) for names in ways]
        if len(found) == 1:
            return found[0]
        frames = [rows.withColumn("_ord", F.concat(F.array(F.lit(f"{k:06d}")), "_ord")) for k, (rows, _, _) in enumerate(found)]
        kinds: dict[str, set[str]] = {}
        for f in frames:
            for x in f.schema.fields:
                kinds.setdefault(x.name, set()).add(x.dataType.simpleString())
        mixed = [c for c, k in kinds.items() if len(k) > 1]
        frames = [f.withColumns({c: F.col(quote(c)).cast("string") for c in mixed if c in f.columns}) for f in frames]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        tables, ends = {t for _, t, _ in found}, {k for _, _, k in found}
        return out, tables.pop() if len(tables) == 1 else None, ends.pop() if len(ends) == 1 else None

    def ways(self, parts: list[A.Part], fields: bool) -> list[list[str | None]]:
        """The table of each step, for every way through steps that name several tables or any."""
        out: list[tuple[list[str | None], str | None, bool]] = [([], self.scope.table, False)]
        for k, p in enumerate(parts):
            only_ids = k == len(parts) - 1 and not fields
            out = [([*names, n], at, edge) for names, table, on_edge in out for n, at, edge in self.step_tables(p.value, table, on_edge, only_ids)]
        return [names for names, _, _ in out]

    def step_tables(self, g: A.Graph, table: str | None, on_edge: bool, only_ids: bool) -> list[tuple[str | None, str | None, bool]]:
        """(named table, table that is reached, whether it holds edges) of the ways on from a table."""
        known, any_ = self.catalog.tables, g.tables == ["*"]
        if g.direction == "ref":
            names = sorted(t.name for t in known.values() if table in t.links.values()) if any_ else g.tables
            return [(n, n, False) for n in names]
        if not on_edge:
            if not any_:
                return [(n, n, True) for n in g.tables]
            fits = lambda e: {"out": e.from_table in ("", table), "in": e.to_table in ("", table), "both": table in (e.from_table, e.to_table) or "" in (e.from_table, e.to_table)}[g.direction]
            return [(n, n, True) for n in sorted(t.name for t in known.values() if t.edge and (table is None or fits(t.edge)))]
        e = known[table].edge
        ends = list(dict.fromkeys({"out": [e.to_table], "in": [e.from_table], "both": [e.to_table, e.from_table]}[g.direction]))
        if any_:
            if only_ids:
                return [(None, ends[0], False)]
            nodes = ends if all(ends) else sorted(t.name for t in known.values() if not t.edge and t.key and not t.info.get("plain_key"))
            return [(n, n, False) for n in nodes]
        edge = lambda n: bool(n in known and known[n].edge)
        return [(n, n, edge(n)) for n in g.tables if not all(ends) or n in ends or edge(n) or n not in known]

    def walk_way(self, parts: list[A.Part], names: list[str | None], several: bool, counted: bool = False) -> tuple[DataFrame, str | None, str | None]:
        rows, table, on_edge, met = None, self.scope.table, False, False
        for k, (p, name) in enumerate(zip(parts, names)):
            if met:
                met = False
                continue
            g: A.Graph = p.value
            if g.direction == "ref":
                t = self.catalog.table(name)
                col = next((c for c, target in t.links.items() if target == table), None)
                if col is None:
                    raise QueryError(f"{name} has no field that refers to {table}")
                side = self.filtered(t.name, g)
                side = side.withColumns({"_met": F.col(col), "_eo": F.concat_ws("\x01", *[graph.pad(F.col(c), side.schema[c].dataType) for c in t.sort])})
                rows = self.join_step(rows, side, F.col(t.key) if t.key else F.lit(None))
                table, on_edge = name, False
                continue
            t = self.catalog.tables.get(name) if name else None
            if on_edge and (t is None or not t.edge):
                # from an edge to the node at its end
                if t is not None:
                    n = self.filtered(t.name, g)
                    rows = rows.join(n.select(*[F.col(quote(c)).alias("_n_" + c) for c in n.columns]), F.col("_reached") == F.col("_n_" + t.key)).select("_src", "_ord", F.col("_reached").alias("_at"), *[F.col("_n_" + c).alias(c) for c in n.columns])
                    table = t.name
                elif name:
                    raise QueryError(f"there is no table {name}")
                else:
                    e = self.catalog.table(table).edge
                    table = e.to_table if g.direction == "out" else e.from_table
                    rows = rows.select("_src", "_ord", F.col("_reached").alias("_at"))
                on_edge = False
                continue
            if t is None or not t.edge:
                raise QueryError(f"{name} is not an edge table")
            side = graph.edge_rows(t, g.direction, self.filtered(t.name, g))
            node = self.catalog.tables.get(names[k + 1]) if k + 1 < len(names) and names[k + 1] else None
            if counted and rows is not None and node is not None and not node.edge and parts[k + 1].value.direction != "ref":
                n = self.filtered(node.name, parts[k + 1].value)
                side = side.select("_met", "_eo", "_reached").join(n.select(*[F.col(quote(c)).alias("_n_" + c) for c in n.columns]), F.col("_reached") == F.col("_n_" + node.key))
                side = side.select("_met", "_eo", F.col("_reached").alias("_end"), *[F.col("_n_" + c).alias(c) for c in n.columns])
                rows = self.join_step(rows, side, F.col("_end")).drop("_end")
                table, on_edge, met = node.name, False, True
                continue
            rows = self.join_step(rows, side, F.col("_reached"))
            table, on_edge = t.name, True
        if several and on_edge:
            key = self.catalog.table(table).key
            rows = rows.withColumn("_rid", F.col(quote(key)).cast("string") if key and key in rows.columns else F.lit(None).cast("string"))
        return rows, table, "edge" if on_edge else None

    def filtered(self, name: str, g: A.Graph) -> DataFrame:
        p = Planner(self.catalog, self.params)
        p.df, p.scope.table = self.table(name), name
        p.where(g.where)
        return p.df

    def join_step(self, rows: DataFrame | None, side: DataFrame, at: F.Column) -> DataFrame:
        side = side.withColumn("_here", at)
        cols = [c for c in side.columns if c not in ("_met", "_eo", "_here")]
        if rows is None:
            return side.select(F.col("_met").alias("_src"), F.array("_eo").alias("_ord"), F.col("_here").alias("_at"), *[F.col(quote(c)) for c in cols])
        left = rows.select("_src", "_ord", F.col("_at").alias("_from"))
        return left.join(side, F.col("_from") == F.col("_met")).select("_src", F.array_append("_ord", F.col("_eo")).alias("_ord"), F.col("_here").alias("_at"), *[F.col(quote(c)) for c in cols])

    def degree(self, n: A.Idiom, scope: Scope) -> Val:
        """count(->edge): one aggregation by start and a left join."""
        mark = ("degree", repr(n.parts))
        if mark not in self.joined:
            name = self.fresh("d")
            rows = self.walk(n.parts)[0].groupBy(F.col("_src").alias(name + "_k")).agg(F.count(F.lit(1)).alias(name))
            self.df = self.df.join(rows, F.col(quote(self.key())) == F.col(name + "_k"), "left")
            self.joined[mark] = name
        return Val(f"coalesce({self.joined[mark]}, 0L)", T.LongType())

    def graph(self, v: Val | None, parts: list[A.Part], scope: Scope) -> Val:
        if parts[0].kind == "recurse":
            return self.recursion(v, parts, scope)
        k = 0
        while k < len(parts) and parts[k].kind == "graph":
            k += 1
        steps, rest = parts[:k], parts[k:]
        mark = ("graph", repr(parts), v.sql if v is not None else "")
        if mark not in self.joined:
            fields = []
            while rest and rest[0].kind in ("field", "all", "destructure"):
                fields.append(rest.pop(0))
            rows, table, kind = self.walk_from(v, steps, bool(fields))
            inner = Planner(self.catalog, self.params)
            inner.df, inner.scope.table = rows, table
            if fields and fields[0].kind == "all":
                value = C.this(inner.scope)
                fields = fields[1:]
            elif fields:
                value = compile(A.Idiom(None, fields), inner.scope) if fields[0].kind == "field" else C.part(C.this(inner.scope), fields[0], inner.scope)
            else:
                value = self.end(rows, table, kind)
            name = self.fresh("g")
            found = self.in_order(inner, rows.selectExpr("*", f"{value.sql} AS _v"), steps[-1].value)
            found = found.groupBy(F.col("_src").alias(name + "_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_v"))), lambda x: x["_v"]).alias(name))
            key = quote(self.key()) if v is None else v.sql
            self.df = self.df.join(found, F.expr(key) == F.col(name + "_k"), "left")
            self.joined[mark] = name
            self.joined[("rest", *mark)] = rest
        name = self.joined[mark]
        out = Val(f"coalesce({name}, array())", self.df.schema[name].dataType)
        for p in self.joined[("rest", *mark)]:
            out = C.part(out, p, scope)
        return out

    def end(self, rows: DataFrame, table: str | None, kind: str | None) -> Val:
        """The record where a walk's rows stand."""
        if kind == "edge" and table is None:
            return Val("`_rid`", T.StringType())
        t = self.catalog.tables.get(table or "")
        return Val(quote(t.key), T.NullType()) if t and t.key and t.key in rows.columns and kind == "edge" else Val("`_at`", T.NullType())

    def size(self, parts: list[A.Part], distinct: bool) -> Val:
        """array::len of a walk, or of its distinct records: the order does not matter, so rows are counted and not gathered."""
        mark = ("size", distinct, repr(parts))
        if mark not in self.joined:
            name = self.fresh("z")
            rows, table, kind = self.walk(parts, counted=True)
            rows = rows.filter("_src IS NOT NULL").selectExpr("_src", f"{self.end(rows, table, kind).sql} AS _v")
            if distinct:  # dealt by start at once: pairs seldom repeat within a task of the join
                rows = rows.repartition("_src").distinct()
            found = rows.groupBy(F.col("_src").alias(name + "_k")).agg(F.count(F.lit(1)).alias(name))
            self.df = self.df.join(found, F.col(quote(self.key())) == F.col(name + "_k"), "left")
            self.joined[mark] = name
        return Val(f"coalesce({self.joined[mark]}, 0L)", T.LongType())

    def in_order(self, inner: Planner, rows: DataFrame, g: A.Graph) -> DataFrame:
        """(_src, _place, _v) with the step's ORDER, START and LIMIT applied to each start's rows."""
        if not g.order and g.limit is None and g.start is None:
            return rows.select("_src", F.col("_ord").alias("_place"), "_v")
        first = int(constant(g.start, self.catalog, self.params)) if g.start is not None else 0
        inner.df = rows
        ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_src").orderBy(*[inner.order_column(o) for o in g.order], "_ord")))
        if first:
            ranked = ranked.filter(F.col("_place") > first)
        if g.limit is not None:
            ranked = ranked.filter(F.col("_place") <= first + int(constant(g.limit, self.catalog, self.params)))
        return ranked.select("_src", "_place", "_v")

    def walk_from(self, v: Val | None, steps: list[A.Part], fields: bool = False) -> tuple[DataFrame, str | None, str | None]:
        if v is not None and v.link:
            p = Planner(self.catalog, self.params)
            p.scope.table = v.link
            return p.walk(steps, fields)
        return self.walk(steps, fields)

    def recursion(self, v: Val | None, parts: list[A.Part], scope: Scope) -> Val:
        """record.{1..3+collect}(->edge->node): levels of joins from the frame's keys."""
        r: A.Recurse = parts[0].value
        t = self.catalog.tables.get((v.link if v is not None and v.link else None) or self.scope.table or "")
        steps = r.parts
        if steps and steps[0].kind == "graph":
            if any(p.kind != "graph" for p in steps):
                raise QueryError("a repeated path holds graph steps only, or one field")
            if any(p.value.order or p.value.limit is not None or p.value.start is not None for p in steps):
                raise QueryError("ORDER, LIMIT and START have no place in a repeated step")
            at = Planner(self.catalog, self.params)
            at.scope.table = t.name if t else self.scope.table
            hop = None
            for names in at.ways(steps, False):
                hops = [(p.value.direction, e, at.filtered(n, p.value)) for p, n in zip(steps, names) if n and (e := self.catalog.table(n)).edge]
                nodes = [(i, self.catalog.table(n), at.filtered(n, p.value)) for i, (p, n) in enumerate(zip(steps, names)) if n and not self.catalog.table(n).edge and p.value.where is not None]
                one = graph.pairs(hops)
                if any(i != len(steps) - 1 for i, _, _ in nodes):
                    raise QueryError("a condition on a node can only stand in a repeated path's last step")
                for _, table, rows in nodes:
                    one = one.join(rows.select(F.col(table.key).alias("_n")), F.col("_to") == F.col("_n"), "left_semi")
                hop = one if hop is None else hop.unionByName(one)
        else:
            field = steps[0].value
            rows = t.df()
            hop = rows.select(F.col(t.key).alias("_from"), (F.explode(field) if isinstance(rows.schema[field].dataType, T.ArrayType) else F.col(field)).alias("_to"))
        key = quote(t.key) if v is None else v.sql
        starts = self.df.select(F.expr(key).alias("start")) if self.df is not None else self.catalog.spark.range(1).selectExpr(f"{v.sql} AS start")
        target = constant(r.target, self.catalog, self.params) if r.target is not None else None
        how = r.instruction or "default"
        found = graph.recurse(starts, hop, how, r.least, r.most, target, r.inclusive)
        name = self.fresh("r")
        if how == "collect":
            found = found.groupBy(F.col("start").alias(name + "_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias(name))
        elif how == "path":
            found = found.groupBy(F.col("start").alias(name + "_k")).agg(F.array_sort(F.collect_list("path")).alias(name))
        elif how == "shortest":
            found = found.select(F.col("start").alias(name + "_k"), F.col("path").alias(name))
        else:
            found = found.groupBy(F.col("start").alias(name + "_k")).agg(F.array_sort(F.collect_list("node")).alias(name))
        if self.df is None:
            self.df = starts
            key = "start"
        self.df = self.df.join(found, F.expr(key) == F.col(name + "_k"), "left")
        return Val(name, self.df.schema[name].dataType)

    def parent(self, parts: list[A.Part], scope: Scope) -> Val:
        if self.outer is None:
            raise QueryError("$parent has no meaning here")
        raise QueryError("$parent can only stand in an equality of a subquery's WHERE")

    def subquery(self, s: A.Select, scope: Scope) -> Val:
        """A subquery as a value: its rows as an array; with $parent equalities, one array per key, joined."""
        inner = Planner(self.catalog, self.params, self)
        inner.n = self.n
        inner.start(s)
        inner.where(s.where)
        if inner.correlated:
            return self.correlate(inner, s)
        plain = A.Select(**{**s.__dict__, "where": None, "sources": []})
        for n in s.split:
            inner.split(n)
        rows = inner.finish(inner.grouped(plain) if s.group is not None else inner.projected(plain, {}), plain)
        return self.frame_value(rows, s.value, s.only)

    def frame_value(self, rows: DataFrame, value: bool = False, only: bool = False) -> Val:
        """A frame of few rows as a literal array, collected on the driver."""
        item = F.col(quote(rows.columns[0])) if value or len(rows.columns) == 1 and value else F.struct(*[F.col(quote(c)) for c in rows.columns])
        name = self.fresh("s")
        one = rows.select(item.alias("x")).agg(F.collect_list("x").alias(name))
        if self.df is None:
            self.df = one
        else:
            self.df = self.df.crossJoin(F.broadcast(one))
        v = Val(quote(name), one.schema[name].dataType)
        return C.part(v, A.Part("index", A.Lit(0)), self.scope) if only else v

    def correlate(self, inner: Planner, s: A.Select) -> Val:
        keys = [(self.fresh("ck"), i, o) for i, o in inner.correlated]
        for name, i, _ in keys:
            inner.df = inner.df.withColumn(name, F.expr(i))
        names = [k for k, _, _ in keys]
        out = self.fresh("c")
        plain = A.Select(**{**s.__dict__, "where": None})
        key_cols = [A.Column(A.Idiom(None, [A.Part("field", k)]), k) for k in names]
        plain.columns = s.columns + key_cols
        if s.group is not None:
            plain.group = [A.Idiom(None, [A.Part("field", k)]) for k in names] + s.group
        plain.limit = plain.start = None
        plain.order = []
        plain.value = False
        inner.correlated = []
        rows = inner.grouped(plain) if s.group is not None else inner.projected(plain, {})
        shown = [c for c in rows.columns if c not in names]
        item = F.col(quote(shown[0])) if s.value else F.struct(*[F.col(quote(c)) for c in shown])
        keyed = rows.withColumn("_x", item)
        if s.order or s.limit is not None:
            w = Window.partitionBy(*names).orderBy(*[F.expr(quote(default_name(o.expr))).desc() if o.descending else F.expr(quote(default_name(o.expr))).asc() for o in s.order] or [F.lit(1)])
            keyed = keyed.withColumn("_r", F.row_number().over(w))
            if s.limit is not None:
                keyed = keyed.filter(F.col("_r") <= int(constant(s.limit, self.catalog, self.params)))
            packed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_x"))), lambda x: x["_x"])
        else:
            packed = F.array_sort(F.collect_list("_x"))
        side = keyed.groupBy(*names).agg(packed.alias(out))
        cond = None
        for name, _, o in keys:
            c = F.expr(o) == F.col(name)
            cond = c if cond is None else cond & c
        self.df = self.df.join(side, cond, "left")
        v = Val(f"coalesce({quote(out)}, array())", self.df.schema[out].dataType)
        return C.part(v, A.Part("index", A.Lit(0)), self.scope) if s.only else v

    def inside(self, left: A.Node, s: A.Select, scope: Scope, negate: bool) -> Val:
        v, rows = compile(left, scope), self.subquery(A.Select(**{**s.__dict__, "value": True}), scope)
        sql = f"coalesce(array_contains({rows.sql}, {v.sql}), false)"
        return Val(f"(NOT {sql})" if negate else sql, T.BooleanType())

    def exists(self, v: Val, scope: Scope) -> Val:
        t = self.catalog.tables.get(v.link or "")
        if t is None:
            return lit(False)
        name = self.fresh("e")
        side = t.df().select(F.col(t.key).alias(name)).distinct()
        if self.df is None:
            self.df = self.catalog.spark.range(1).selectExpr("id AS _one")
        self.df = self.df.join(side, F.expr(v.sql) == F.col(name), "left")
        return Val(f"({name} IS NOT NULL)", T.BooleanType())

    # search

    def prepare_matches(self, n: A.Node) -> None:
        for m in matches_in(n):
            ref = str(m.extra) if str(m.extra).isdigit() else "0"
            field = default_name(m.left)
            analyzer = self.analyzer(field)
            col = self.fresh("t")
            terms = fulltext.query_terms(self.catalog, analyzer, str(constant(m.right, self.catalog, self.params)))
            self.df = fulltext.token_columns(self.df, self.catalog, analyzer, field, col, terms)
            self.df = fulltext.with_scores(self.df, col, terms, f"_score{ref}")
            self.terms[ref] = (field, terms)
            m.extra = (m.extra, col, terms)

    def analyzer(self, field: str) -> str | None:
        t = self.catalog.tables.get(self.scope.table or "")
        for i in (t.info.get("indexes", {}) if t else {}).values():
            if i.get("analyzer") and any(default_name(f) == field for f in i.get("fields", [])):
                return i["analyzer"]
        return None

    def matches(self, n: A.Bin, scope: Scope) -> Val:
        if not isinstance(n.extra, tuple):
            self.prepare_matches(n)
        how, col, terms = n.extra
        return Val(fulltext.matches_sql(col, terms, "OR" if str(how).upper() == "OR" else "AND"), T.BooleanType())

    def search(self, n: A.Call, scope: Scope) -> Val:
        if n.name in ("search::rrf", "search::linear"):
            return self.fuse(n)
        ref = str(n.args[-1].value if n.name == "search::score" else n.args[2].value if n.name == "search::highlight" else n.args[0].value) if n.args else "0"
        if n.name == "search::score":
            return Val(f"`_score{ref}`", T.DoubleType()) if f"_score{ref}" in self.df.columns else lit(None)
        field, terms = self.terms[ref]
        if n.name == "search::highlight":
            return Val(fulltext.highlight_sql(quote(field), terms, n.args[0].value, n.args[1].value), T.StringType())
        return typed(scope, fulltext.offsets_sql(quote(field), terms))

    def fuse(self, n: A.Call) -> Val:
        lists = []
        for a in n.args[0].items:
            v = self.params.get(a.name) if isinstance(a, A.Param) else None
            lists.append(v if isinstance(v, DataFrame) else Planner(self.catalog, self.params).select(a))
        key = lists[0].columns[0]
        cols = [df.columns[1] for df in lists]
        if n.name == "search::rrf":
            rest = [constant(a, self.catalog, self.params) for a in n.args[1:]]
            out = fulltext.rrf(lists, key, [(c, "dist" not in c) for c in cols], int(rest[1]) if len(rest) > 1 else 60, int(rest[0]))
        else:
            weights, limit, norm = (constant(a, self.catalog, self.params) for a in n.args[1:4])
            out = fulltext.linear(lists, key, cols, list(weights), norm, int(limit))
        return self.frame_value(out)

    def nearest(self, n: A.Bin, scope: Scope) -> Val:
        raise QueryError("a nearest-neighbour condition stands alone or in a chain of ANDs")

    def rank(self, n: A.Bin) -> None:
        """The k nearest rows that the other conditions leave: a distance column and a bounded sort."""
        k, how, p = n.extra
        metric = how if isinstance(how, str) else "euclidean"
        args = [n.left, n.right, *([A.Lit(p)] if metric == "minkowski" else [])]
        v = compile(A.Call(METRICS[metric], args), self.scope)
        if metric in ("jaccard", "pearson"):
            v = Val(f"(1D - {v.sql})", T.DoubleType())
        ties = [F.col(quote(c)) for c in (self.catalog.tables[self.scope.table].sort if self.scope.table in self.catalog.tables else [])]
        self.df = self.df.withColumn("_knn", F.expr(f"double({v.sql})")).filter("_knn IS NOT NULL").orderBy("_knn", *ties).limit(k)


def limited(df: DataFrame, s: A.Select, catalog: Catalog, params: dict[str, Any]) -> DataFrame:
    if s.start is not None:
        df = df.offset(int(constant(s.start, catalog, params)))
    if s.limit is not None:
        df = df.limit(int(constant(s.limit, catalog, params)))
    return df


def omit(df: DataFrame, names: list[A.Node]) -> DataFrame:
    for n in names:
        path = [p.value for p in n.parts if p.kind == "field"]
        if len(path) == 1:
            df = df.drop(path[0])
        elif path[0] in df.columns:
            df = df.withColumn(path[0], F.col(path[0]).dropFields(".".join(path[1:])))
    return df


def is_parent(n: A.Node) -> bool:
    return isinstance(n, A.Idiom) and isinstance(n.start, A.Param) and n.start.name == "parent"


def mentions_parent(n: Any) -> bool:
    return "Param(name='parent')" in repr(n)


def has_aggregate(n: Any) -> bool:
    """Whether an argument is worked out over the group's values, so that the function around it is not an aggregate."""
    return isinstance(n, A.Call) and (n.name in AGGREGATES or n.name.startswith(("array::", "set::")))


def matches_in(n: Any) -> list[A.Bin]:
    if isinstance(n, A.Bin):
        if n.op == "@@":
            return [n]
        return matches_in(n.left) + matches_in(n.right)
    return matches_in(n.arg) if isinstance(n, A.Un) else []


def contains_match(n: A.Node) -> bool:
    return bool(matches_in(n))


def constant(n: A.Node, catalog: Catalog, params: dict[str, Any]) -> Any:
    """The Python value of an expression without columns."""
    if isinstance(n, A.Lit) and n.kind == "":
        return n.value
    if isinstance(n, A.Param) and n.name in params and not isinstance(params[n.name], (Val, DataFrame)):
        return params[n.name]
    p = Planner(catalog, params)
    v = compile(n, p.scope)
    base = p.df if p.df is not None else catalog.spark.range(1)
    return plain(base.selectExpr(f"{v.sql} AS x").first()[0])


def plain(x: Any) -> Any:
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x
