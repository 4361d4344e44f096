"""Statements one after the other: reads, writes, definitions, control flow."""

from __future__ import annotations

import time
import uuid
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from omniframe.plans import ast as A
from omniframe.plans.compiler import QueryError
from omniframe.plans.planner import Planner, constant, plain

if TYPE_CHECKING:
    from omniframe.engine import Engine


class Signal(Exception):
    """BREAK, CONTINUE or RETURN on its way out."""

    def __init__(self, kind: str, value: Any = None) -> None:
        super().__init__(kind)
        self.kind, self.value = kind, value


class Thrown(QueryError):
    """THROW."""


class Runner:
    def __init__(self, engine: Engine, params: dict[str, Any] | None = None) -> None:
        self.engine, self.catalog, self.spark = engine, engine.catalog, engine.spark
        self.params = dict(params or {})
        self.saved: dict[str, Any] | None = None

    def run(self, statements: list[A.Node]) -> list[Any]:
        out = []
        for s in statements:
            try:
                out.append(self.statement(s))
            except Signal as x:
                if x.kind != "return":
                    raise QueryError(f"{x.kind.upper()} outside a loop") from None
                out.append(x.value)
        return out

    def statement(self, s: A.Node) -> Any:
        if isinstance(s, A.Select):
            return self.select(s)
        if not isinstance(s, A.Statement):
            return self.value(s)
        return getattr(self, f"do_{s.kind.lower()}")(s.clauses)

    def select(self, s: A.Select) -> Any:
        df = Planner(self.catalog, self.params).select(s)
        if s.explain:
            return explained(df, False)
        if s.timeout is not None:
            return self.within(df, constant(s.timeout, self.catalog, self.params).total_seconds())
        if s.only:
            rows = df.take(1)
            return plain(rows[0]) if rows else None
        return df

    def within(self, df: DataFrame, seconds: float) -> DataFrame:
        """The rows, computed now; the job is cancelled when the time is over."""
        import threading

        tag = f"timeout-{uuid.uuid4().hex}"
        timer = threading.Timer(seconds, lambda: self.spark.interruptTag(tag))
        self.spark.addTag(tag)
        timer.start()
        try:
            kept = df.cache()
            kept.count()
            return kept
        except Exception as x:
            raise QueryError("the query ran out of time") from x
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def value(self, n: A.Node) -> Any:
        """An expression's value; a DataFrame if it is a query."""
        if isinstance(n, (A.Select, A.Statement)):
            return self.statement(n)
        if isinstance(n, A.Block):
            return self.block(n)
        if isinstance(n, A.If):
            return self.do_if({"if": n})
        if isinstance(n, A.Closure):
            return n
        if isinstance(n, A.Param) and isinstance(self.params.get(n.name), (DataFrame, A.Closure)):
            return self.params[n.name]
        if isinstance(n, A.Call) and n.name.startswith("fn::") and n.name in self.catalog.functions:
            f = self.catalog.functions[n.name]
            inner = Runner(self.engine, self.params | {p: self.value(a) for (p, _), a in zip(f["params"], n.args)})
            try:
                return inner.block(f["body"])
            except Signal as x:
                if x.kind != "return":
                    raise
                return x.value
        if isinstance(n, A.Call) and n.name.startswith("$") and isinstance(self.params.get(n.name[1:]), A.Closure):
            f = self.params[n.name[1:]]
            inner = Runner(self.engine, self.params | {p: self.value(a) for p, a in zip(f.params, n.args)})
            return inner.value(f.body)
        return constant(n, self.catalog, self.params)

    def block(self, b: A.Block) -> Any:
        out = None
        for s in b.body:
            out = self.statement(s)
        return out

    def truth(self, n: A.Node) -> bool:
        v = self.value(n)
        if isinstance(v, DataFrame):
            return not v.isEmpty()
        return bool(v) if not isinstance(v, float) else v != 0

    # control flow

    def do_let(self, c: dict[str, Any]) -> None:
        self.params[c["name"]] = self.value(c["value"])

    def do_return(self, c: dict[str, Any]) -> Any:
        raise Signal("return", self.value(c["value"]))

    def do_if(self, c: dict[str, Any]) -> Any:
        n: A.If = c["if"]
        for cond, body in n.branches:
            if self.truth(cond):
                return self.value(body)
        return self.value(n.other) if n.other is not None else None

    def do_for(self, c: dict[str, Any]) -> None:
        n = c["in"]
        if isinstance(n, A.Range):
            lo, hi = constant(n.begin, self.catalog, self.params), constant(n.end, self.catalog, self.params)
            items: Any = range(lo + n.skip, hi + n.inclusive)
        else:
            items = self.value(n)
        if isinstance(items, DataFrame):
            items = (plain(r) if len(r) > 1 else plain(r[0]) for r in items.toLocalIterator())
        for x in items:
            self.params[c["name"]] = x
            try:
                self.block(c["body"])
            except Signal as s:
                if s.kind == "break":
                    break
                if s.kind != "continue":
                    raise

    def do_break(self, c: dict[str, Any]) -> None:
        raise Signal("break")

    def do_continue(self, c: dict[str, Any]) -> None:
        raise Signal("continue")

    def do_throw(self, c: dict[str, Any]) -> None:
        raise Thrown(str(self.value(c["value"])))

    def do_sleep(self, c: dict[str, Any]) -> None:
        time.sleep(constant(c["for"], self.catalog, self.params).total_seconds())

    def do_use(self, c: dict[str, Any]) -> None:
        self.catalog.session.update(c)

    def do_option(self, c: dict[str, Any]) -> None:
        self.catalog.session[f"option:{c['name']}"] = constant(c["value"], self.catalog, self.params)

    def do_begin(self, c: dict[str, Any]) -> None:
        self.saved = {n: (t.load, dict(t.info), list(t.versions)) for n, t in self.catalog.tables.items()}

    def do_commit(self, c: dict[str, Any]) -> None:
        self.saved = None

    def do_cancel(self, c: dict[str, Any]) -> None:
        """Tables as they were at BEGIN; rows are immutable frames, so this is a change of pointers."""
        if self.saved is None:
            raise QueryError("no transaction was begun")
        for name in list(self.catalog.tables):
            if name not in self.saved:
                del self.catalog.tables[name]
                continue
            t = self.catalog.tables[name]
            t.load, t.info, t.versions = self.saved[name]
        self.saved = None

    def do_explain(self, c: dict[str, Any]) -> Any:
        return explained(Planner(self.catalog, self.params).select(c["statement"]), c["analyze"])

    # definitions

    def do_define(self, c: dict[str, Any], alter: bool = False) -> None:
        from omniframe.plans import definitions

        definitions.define(self, c, alter)

    def do_alter(self, c: dict[str, Any]) -> None:
        self.do_define(c, True)

    def do_remove(self, c: dict[str, Any]) -> None:
        from omniframe.plans import definitions

        definitions.remove(self, c)

    def do_info(self, c: dict[str, Any]) -> Any:
        from omniframe.plans import definitions

        return definitions.info(self, c)

    def do_rebuild(self, c: dict[str, Any]) -> None:
        """Indexes are layouts that are derived when read; there is nothing stale to build again."""

    # writes

    def do_create(self, c: dict[str, Any]) -> Any:
        from omniframe.operators import writes

        return writes.create(self, c)

    def do_insert(self, c: dict[str, Any]) -> Any:
        from omniframe.operators import writes

        return writes.insert(self, c)

    def do_update(self, c: dict[str, Any]) -> Any:
        from omniframe.operators import writes

        return writes.update(self, c, False)

    def do_upsert(self, c: dict[str, Any]) -> Any:
        from omniframe.operators import writes

        return writes.update(self, c, True)

    def do_delete(self, c: dict[str, Any]) -> Any:
        from omniframe.operators import writes

        return writes.delete(self, c)

    def do_relate(self, c: dict[str, Any]) -> Any:
        from omniframe.operators import writes

        return writes.relate(self, c)

    # streams

    def do_live(self, c: dict[str, Any]) -> str:
        from omniframe.streaming import live

        return live.start(self, c)

    def do_kill(self, c: dict[str, Any]) -> None:
        from omniframe.streaming import live

        live.stop(self, str(self.value(c["id"])))

    def do_show(self, c: dict[str, Any]) -> DataFrame:
        from omniframe.streaming import changes

        return changes.show(self, c)


def explained(df: DataFrame, analyze: bool) -> str:
    """The plan's text; with analyze, after running it, so that it is the one that ran."""
    if analyze:
        df.write.format("noop").mode("overwrite").save()
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

