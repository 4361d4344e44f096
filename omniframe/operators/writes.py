"""CREATE, INSERT, UPDATE, UPSERT, DELETE and RELATE as copy-on-write rewrites.

A write plans the table's next version from its last as one DataFrame (a union, a
conditional projection, a filter or an anti join), stores it as Parquet and points
the catalog to it. Earlier versions stay readable (VERSION), transactions are
changes of pointers, and no row is touched one by one.
"""

from __future__ import annotations

import time
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omniframe.plans import ast as A
from omniframe.plans import definitions
from omniframe.plans.catalog import Table
from omniframe.plans.compiler import KINDS, QueryError, compile, condition, lit
from omniframe.plans.planner import Planner, plain
from omniframe.plans.values import Val, quote, truthy
from omniframe.sources import storage

if TYPE_CHECKING:
    from omniframe.plans.runner import Runner


def named(n: A.Node) -> tuple[str, A.Node | None]:
    """A target's table, and its record id if it names one."""
    if isinstance(n, A.RecordId):
        return n.table, n
    if isinstance(n, A.Idiom):
        return n.parts[0].value, None
    if isinstance(n, A.Lit) and isinstance(n.value, str):
        table, _, key = n.value.partition(":")
        return table, A.RecordId(table, A.Lit(key)) if key else None
    raise QueryError("a table or record is wanted")


def fields_of(r: Runner, c: dict[str, Any], planner: Planner) -> dict[str, Val]:
    """The columns that SET, CONTENT, MERGE or REPLACE give to new rows."""
    out: dict[str, Val] = {}
    for target, op, node in c.get("set", []):
        path = [p.value for p in target.parts]
        v = compile(node, planner.scope)
        if op != "=" and len(path) == 1:
            v = changed(out.get(path[0], lit(None)), op, v)
        if len(path) > 1:
            v = nested(out.get(path[0]), path[1:], v)
        out[path[0]] = v
    for clause in ("content", "merge", "replace"):
        if clause in c:
            out |= columns_of(r, c[clause], planner)
    return out


def nested(old: Val | None, path: list[str], v: Val) -> Val:
    """An object with the value at the path, other fields kept."""
    fields = {f.name: Val(f"{old.sql}.{quote(f.name)}", f.dataType) for f in old.type.fields} if old is not None and isinstance(old.type, T.StructType) else {}
    fields[path[0]] = nested(fields.get(path[0]), path[1:], v) if len(path) > 1 else v
    sql = "named_struct(" + ", ".join(f"'{k}', {x.sql}" for k, x in fields.items()) + ")"
    return Val(sql, T.StructType([T.StructField(k, x.type) for k, x in fields.items()]))


def columns_of(r: Runner, n: A.Node, planner: Planner) -> dict[str, Val]:
    if isinstance(n, A.Obj):
        return {k: compile(v, planner.scope) for k, v in n.items}
    v = r.value(n)
    if not isinstance(v, dict):
        raise QueryError("an object is wanted")
    return {k: lit(x) for k, x in v.items()}


def changed(old: Val, op: str, v: Val) -> Val:
    if op == "+=":
        if old.family == "array":
            return Val(f"concat({old.sql}, {v.sql})" if v.family == "array" else f"array_append({old.sql}, {v.sql})", old.type)
        if old.family == "none":
            return v
        return Val(f"coalesce({old.sql} + {v.sql}, {v.sql})" if old.family == "number" else f"concat({old.sql}, {v.sql})" if old.family == "string" else f"({old.sql} + {v.sql})", old.type if old.family != "number" else v.type)
    if op == "-=":
        return Val(f"filter({old.sql}, x -> x <> {v.sql})" if old.family == "array" else f"({old.sql} - {v.sql})", old.type)
    if op == "+?=":
        return Val(f"if(array_contains({old.sql}, {v.sql}), {old.sql}, array_append({old.sql}, {v.sql}))", old.type)
    return v


def key_of(t: Table, record: A.Node | None, fields: dict[str, Val], planner: Planner) -> Val:
    """A new row's id: the target's, the content's, or a fresh one."""
    if record is not None:
        return compile(record, planner.scope)
    given = fields.pop("id", None) or (fields.get(t.key) if t.info.get("plain_key") else None)
    if given is not None:
        if t.info.get("plain_key"):
            return given
        return Val(f"if(startswith(string({given.sql}), '{t.name}:'), string({given.sql}), concat('{t.name}:', string({given.sql})))", T.StringType())
    return Val(f"concat('{t.name}:', lower(substr(replace(uuid(), '-', ''), 1, 20)))", T.StringType())


def new_row(r: Runner, t: Table, record: A.Node | None, c: dict[str, Any]) -> DataFrame:
    planner = Planner(r.catalog, r.params)
    fields = fields_of(r, c, planner)
    key = key_of(t, record, fields, planner)
    fields.pop(t.key, None)
    base = planner.df if planner.df is not None else r.spark.range(1)
    return base.selectExpr(f"{key.sql} AS {quote(t.key)}", *[f"{v.sql} AS {quote(k)}" for k, v in fields.items()])


def ruled(r: Runner, t: Table, df: DataFrame) -> DataFrame:
    """The defined fields' defaults, types, values and assertions applied to rows."""
    for name, f in t.info.get("fields", {}).items():
        if "." in name or "*" in name or "computed" in f:
            continue
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None))
        p = Planner(r.catalog, r.params)
        p.df, p.scope.table = df, t.name
        col = Val(quote(name), df.schema[name].dataType)
        if "default" in f:
            d = compile(f["default"], p.scope)
            col = Val(f"coalesce({col.sql}, {d.sql})" if col.family != "none" else d.sql, d.type if col.family == "none" else col.type)
        kind = str(f.get("type", "")).removeprefix("option<").removesuffix(">") if str(f.get("type", "")).startswith("option<") else str(f.get("type", ""))
        if kind in KINDS:
            col = Val(f"cast({col.sql} as {KINDS[kind]})", T._parse_datatype_string(KINDS[kind]) if kind != "duration" else T.DayTimeIntervalType())
        if "value" in f:
            col = compile(f["value"], p.scope.inner(value=col))
        if "assert" in f:
            ok = truthy(compile(f["assert"], p.scope.inner(value=col)))
            col = Val(f"if({ok}, {col.sql}, raise_error('field {name} of {t.name} breaks its assertion'))", col.type)
        if kind and kind in KINDS and not str(f.get("type", "")).startswith("option<") and "default" not in f and "value" not in f:
            col = Val(f"if({col.sql} IS NULL, raise_error('field {name} of {t.name} has no value'), {col.sql})", col.type)
        df = df.withColumn(name, F.expr(col.sql))
    if t.info.get("schemafull"):
        keep = {t.key, "in", "out", *t.info.get("fields", {})}
        df = df.select(*[quote(c) for c in df.columns if c in keep])
    return df


def fit(x: DataFrame, y: DataFrame) -> DataFrame:
    """x with its columns in y's types where one side has none or both are numbers."""
    for f in x.schema.fields:
        if f.name in y.columns and f.dataType != (other := y.schema[f.name].dataType) and (isinstance(f.dataType, T.NullType) or isinstance(other, T.DoubleType) and isinstance(f.dataType, (T.LongType, T.IntegerType)) or isinstance(other, T.LongType) and isinstance(f.dataType, T.IntegerType)):
            x = x.withColumn(f.name, F.col(quote(f.name)).cast(other))
    return x


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    a = fit(a, b)
    return a.unionByName(fit(b, a), allowMissingColumns=True)


def commit(r: Runner, t: Table, df: DataFrame, before: DataFrame | None, after: DataFrame | None, op: str) -> None:
    """Store the next version, then tell the change feed, live queries and events."""
    df = df.select(*[F.col(quote(f.name)).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(quote(f.name)) for f in df.schema.fields])
    stored = storage.store(r.engine, t.name, df)
    if not t.versions:
        t.versions.append((0.0, t.df()))
    t.load = lambda: stored
    t.versions.append((time.time(), stored))
    if t.info.get("changefeed") or t.info.get("live"):
        from omniframe.streaming import changes

        changes.record(r, t, before, after, op)
    for e in t.info.get("events", {}).values():
        fire(r, t, e, before, after, op)


def fire(r: Runner, t: Table, e: dict[str, Any], before: DataFrame | None, after: DataFrame | None, op: str) -> None:
    """An event's THEN for every changed row that its WHEN holds for."""
    if r.params.get("_depth", 0) > 3:
        return
    rows = {}
    for side, df in (("before", before), ("after", after)):
        if df is not None:
            for x in df.toLocalIterator():
                rows.setdefault(x[t.key], {})[side] = plain(x)
    from omniframe.plans.runner import Runner as Inner

    for pair in rows.values():
        inner = Inner(r.engine, r.params | {"event": op, "before": pair.get("before"), "after": pair.get("after"), "value": pair.get("after") or pair.get("before"), "_depth": r.params.get("_depth", 0) + 1})
        if "when" not in e or inner.truth(e["when"]):
            inner.value(e["then"])


def returned(r: Runner, how: Any, t: Table, before: DataFrame | None, after: DataFrame | None, default: str, only: bool = False) -> Any:
    how = how or default
    if isinstance(how, tuple):
        p = Planner(r.catalog, r.params)
        p.df, p.scope.table = after if after is not None else before, t.name
        cols = how[1] if how[0] == "fields" else [A.Column(how[1], None)]
        out = p.projected(A.Select(columns=cols), {})
    elif how in ("none", "null"):
        out = (after if after is not None else before).limit(0)
    elif how == "before":
        out = before if before is not None else after.limit(0)
    elif how == "diff":
        from omniframe.streaming import changes

        out = changes.pairs(r, t, before, after)
    else:
        out = after if after is not None else before.limit(0)
    if only:
        got = out.take(1)
        return plain(got[0]) if got else None
    return out


def create(r: Runner, c: dict[str, Any]) -> Any:
    out = None
    for target in c["targets"]:
        if isinstance(target, A.Mock):
            t = definitions.ensure(r, target.table)
            rows = r.spark.range(target.begin, target.end + 1).selectExpr(f"concat('{t.name}:', id) AS {quote(t.key)}")
            extra = new_row(r, t, None, c).drop(t.key)
            rows = rows.crossJoin(F.broadcast(extra)) if extra.columns else rows
        else:
            name, record = named(target)
            t = definitions.ensure(r, name)
            rows = new_row(r, t, record, c)
        rows = storage.once(r.engine, ruled(r, t, rows))
        refuse_repeats(t, rows)
        commit(r, t, joined(t.df(), rows), None, rows, "CREATE")
        out = rows if out is None else joined(out, rows)
        last = t
    return returned(r, c.get("return"), last, None, out, "after", c["only"])


def refuse_repeats(t: Table, rows: DataFrame) -> None:
    if not t.df().join(rows.select(t.key), t.key, "left_semi").isEmpty():
        raise QueryError(f"a record of {t.name} with that id is already there")
    for i in t.info.get("indexes", {}).values():
        fields = [f.parts[0].value for f in i.get("fields", [])] if i.get("unique") else []
        if fields and all(f in rows.columns and f in t.df().columns for f in fields) and not t.df().join(fit(rows, t.df()).select(*fields), fields, "left_semi").isEmpty():
            raise QueryError(f"index {i['name']} already holds these values")


def rows_of(r: Runner, t: Table, n: A.Node) -> DataFrame:
    if isinstance(n, A.Obj):
        n = A.Array([n])
    if isinstance(n, A.Array):
        out = None
        for item in n.items:
            row = new_row(r, t, None, {"content": item})
            out = row if out is None else joined(out, row)
        return out
    v = r.value(n)
    if isinstance(v, DataFrame):
        if t.key in v.columns:
            return v if t.info.get("plain_key") else v.withColumn(t.key, F.when(F.col(t.key).cast("string").startswith(f"{t.name}:"), F.col(t.key).cast("string")).otherwise(F.concat(F.lit(f"{t.name}:"), F.col(t.key).cast("string"))))
        return v.withColumn(t.key, F.concat(F.lit(f"{t.name}:"), F.expr("lower(substr(replace(uuid(), '-', ''), 1, 20))")))
    out = None
    for item in v if isinstance(v, list) else [v]:
        fields = {k: lit(x) for k, x in item.items()}
        key = key_of(t, None, fields, Planner(r.catalog, r.params))
        fields.pop(t.key, None)
        row = r.spark.range(1).selectExpr(f"{key.sql} AS {quote(t.key)}", *[f"{x.sql} AS {quote(k)}" for k, x in fields.items()])
        out = row if out is None else joined(out, row)
    return out


def insert(r: Runner, c: dict[str, Any]) -> Any:
    t = definitions.ensure(r, c["into"], c["relation"])
    rows = storage.once(r.engine, ruled(r, t, rows_of(r, t, c["rows"])))
    old = t.df()
    fresh = rows.join(old.select(t.key), t.key, "left_anti").dropDuplicates([t.key])
    if "duplicate" in c:
        p = Planner(r.catalog, r.params)
        given = rows.select(F.col(t.key).alias("_ik"), F.struct(*[quote(x) for x in rows.columns]).alias("_input"))
        both = old.join(given, F.col(t.key) == F.col("_ik"), "left")
        p.df, p.scope.table = both, t.name
        scope = p.scope.inner(input=Val("`_input`", both.schema["_input"].dataType))
        new = {}
        for target, op, node in c["duplicate"]:
            name = target.parts[0].value
            was = Val(quote(name), old.schema[name].dataType) if name in old.columns else lit(None)
            new[name] = changed(was, op, compile(node, scope))
        shown = [f"if(_ik IS NOT NULL, {new[x].sql}, {quote(x)}) AS {quote(x)}" if x in new else quote(x) for x in old.columns]
        kept = p.df.selectExpr(*shown)
        done = storage.once(r.engine, joined(kept, fresh))
        commit(r, t, done, None, rows, "CREATE")
        return returned(r, c.get("return"), t, None, done.join(rows.select(t.key).distinct(), t.key, "left_semi"), "after")
    if not c["ignore"]:
        refuse_repeats(t, rows)
        if not rows.groupBy(t.key).count().filter("count > 1").isEmpty():
            raise QueryError(f"the new records of {t.name} repeat an id")
    commit(r, t, joined(old, fresh), None, fresh, "CREATE")
    return returned(r, c.get("return"), t, None, fresh, "after")


def update(r: Runner, c: dict[str, Any], upsert: bool) -> Any:
    target = c["targets"][0]
    name, record = named(target)
    t = definitions.ensure(r, name) if upsert else r.catalog.table(name)
    p = Planner(r.catalog, r.params)
    p.df, p.scope.table = t.df(), name
    hits = [condition(c["where"], p.scope)] if "where" in c else []
    if record is not None:
        hits.append(f"{quote(t.key)} = {compile(record, p.scope).sql}")
    hit = " AND ".join(f"coalesce({h}, false)" for h in hits) or "true"
    old = p.df
    if upsert and (record is not None or "where" in c) and old.filter(hit).isEmpty():
        return create(r, {**c, "targets": c["targets"]})
    new: dict[str, Val] = {}
    if "content" in c or "replace" in c:
        new = {x: Val("NULL", T.NullType()) for x in old.columns if x not in (t.key, "in", "out") and not x.startswith("_")}
    for target_, op, node in c.get("set", []):
        path = [x.value for x in target_.parts]
        was = new.get(path[0]) or (Val(quote(path[0]), old.schema[path[0]].dataType) if path[0] in old.columns else lit(None))
        v = compile(node, p.scope)
        new[path[0]] = changed(was, op, v) if len(path) == 1 else nested(was, path[1:], v)
    for clause in ("content", "merge", "replace"):
        if clause in c:
            new |= {k: v for k, v in columns_of(r, c[clause], p).items() if k not in ("id", t.key)}
    for n in c.get("unset", []):
        new[n.parts[0].value] = Val("NULL", T.NullType())
    for o in (r.value(c["patch"]) if "patch" in c else []):
        key = o["path"].strip("/").split("/")[0]
        new[key] = lit(None) if o["op"] == "remove" else lit(o["value"])
    base = p.df.withColumn("_hit", F.expr(hit))
    cols = [x for x in t.df().columns]
    def kind(x: str, v: Val) -> str:
        was = t.df().schema[x].dataType
        return f"if(_hit, {v.sql}, {quote(x)}) AS {quote(x)}" if not isinstance(was, T.NullType) else f"if(_hit, {v.sql}, NULL) AS {quote(x)}"

    shown = [kind(x, new[x]) if x in new else quote(x) for x in cols] + [f"if(_hit, {v.sql}, NULL) AS {quote(x)}" for x, v in new.items() if x not in cols]
    marked = storage.once(r.engine, base.selectExpr(*shown, "_hit"))
    after = ruled(r, t, marked.filter("_hit").drop("_hit"))
    before = t.df().filter(hit) if not contains_join(p, t) else t.df().join(after.select(t.key), t.key, "left_semi")
    commit(r, t, joined(marked.filter("NOT _hit").drop("_hit"), after), before, after, "UPDATE")
    return returned(r, c.get("return"), t, before, after, "after", c["only"])


def contains_join(p: Planner, t: Table) -> bool:
    return p.df.columns != t.df().columns


def delete(r: Runner, c: dict[str, Any]) -> Any:
    name, record = named(c["targets"][0])
    t = r.catalog.table(name)
    p = Planner(r.catalog, r.params)
    p.df, p.scope.table = t.df(), name
    p.where(c.get("where"))
    gone = p.df.filter(f"{quote(t.key)} = {compile(record, p.scope).sql}") if record is not None else p.df
    gone = storage.once(r.engine, gone.select(*[quote(x) for x in t.df().columns]))
    commit(r, t, t.df().join(gone.select(t.key), t.key, "left_anti").select(*t.df().columns), gone, None, "DELETE")
    cascade(r, t, gone)
    return returned(r, c.get("return"), t, gone, None, "none", c["only"])


def cascade(r: Runner, t: Table, gone: DataFrame) -> None:
    """Edges of deleted records go; references follow their ON DELETE."""
    ids = gone.select(F.col(t.key).alias("_gone"))
    for other in list(r.catalog.tables.values()):
        if other.edge and not other.info.get("plain_key") and other is not t:
            df = other.df()
            kept = df.join(ids, df[other.edge.from_col] == F.col("_gone"), "left_anti").join(ids, F.col(other.edge.to_col) == F.col("_gone"), "left_anti")
            if kept.count() < df.count():
                lost = df.join(kept.select(other.key), other.key, "left_anti")
                commit(r, other, kept, lost, None, "DELETE")
        for field, f in other.info.get("fields", {}).items():
            how = f.get("reference")
            if other.links.get(field) != t.name or not how or how == "ignore":
                continue
            df = other.df()
            hit = df.join(ids, F.col(quote(field)) == F.col("_gone"), "left_semi")
            if hit.isEmpty():
                continue
            if how == "reject":
                raise QueryError(f"records of {other.name} still refer to these of {t.name}")
            if how == "cascade":
                commit(r, other, df.join(ids, F.col(quote(field)) == F.col("_gone"), "left_anti"), hit, None, "DELETE")
            elif how == "unset":
                done = df.join(ids, F.col(quote(field)) == F.col("_gone"), "left").withColumn(field, F.when(F.col("_gone").isNull(), F.col(quote(field)))).drop("_gone")
                commit(r, other, done, hit, None, "UPDATE")


def ends(r: Runner, n: A.Node) -> list[Any]:
    v = r.value(n)
    if isinstance(v, DataFrame):
        return [row[0] if len(row) == 1 or "id" not in row.asDict() else row["id"] for row in v.toLocalIterator()]
    out = v if isinstance(v, list) else [v]
    return [x["id"] if isinstance(x, dict) and "id" in x else x for x in out]


def relate(r: Runner, c: dict[str, Any]) -> Any:
    edge = c["edge"]
    name, record = (edge.table, edge) if isinstance(edge, A.RecordId) else (edge, None)
    t = definitions.ensure(r, name, True)
    lists = [r.spark.createDataFrame([(x,) for x in ends(r, c[side])], f"{quote(col)} string") for side, col in (("from", "in"), ("to", "out"))]
    pairs = lists[0].crossJoin(lists[1])
    extra = new_row(r, t, record, c)
    if record is not None:
        rows = extra.select(*[x for x in extra.columns if x not in ("in", "out")]).crossJoin(pairs)
    else:
        key = F.expr(f"concat('{name}:', lower(substr(replace(uuid(), '-', ''), 1, 20)))")
        body = extra.select(*[x for x in extra.columns if x not in (t.key, "in", "out")])
        rows = (pairs.crossJoin(body) if body.columns else pairs).withColumn(t.key, key)
    rows = storage.once(r.engine, ruled(r, t, rows))
    refuse_repeats(t, rows)
    for side, col in (("from_table", "in"), ("to_table", "out")):
        met = t.info.setdefault("ends", {}).setdefault(side, {getattr(t.edge, side)} - {""})
        met |= {x[0] for x in rows.select(F.substring_index(col, ":", 1)).distinct().toLocalIterator() if x[0]}
        # edges to several tables have no one end
        setattr(t.edge, side, next(iter(met)) if len(met) == 1 else "")
    commit(r, t, joined(t.df(), rows), None, rows, "CREATE")
    return returned(r, c.get("return"), t, None, rows, "after", c["only"])

