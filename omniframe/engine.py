"""The engine's front door: a catalog, and queries over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from omniframe.plans.catalog import Catalog, Edge
from omniframe.plans.parser import parse


class Engine:
    """Tables, and the statements that read and change them."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None) -> None:
        self.spark, self.catalog = spark, Catalog(spark)
        self.warehouse = warehouse

    def add(self, name: str, df: DataFrame, **more: Any) -> Engine:
        self.catalog.add(name, df, **more)
        return self

    def query(self, text: str, params: dict[str, Any] | None = None) -> list[Any]:
        """One result a statement: a DataFrame for rows, else a Python value."""
        from omniframe.plans.runner import Runner

        return Runner(self, params).run(parse(text))

    def sql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows of the last statement."""
        out = self.query(text, params)[-1]
        if not isinstance(out, DataFrame):
            raise TypeError(f"the last statement gave {type(out).__name__}, not rows")
        return out

    def value(self, text: str, params: dict[str, Any] | None = None) -> Any:
        """The last statement's result as a Python value."""
        from omniframe.plans.planner import plain

        out = self.query(text, params)[-1]
        return [plain(r) for r in out.collect()] if isinstance(out, DataFrame) else out

    # one method a statement

    def select(self, table: str, where: str = "", columns: str = "*") -> DataFrame:
        return self.sql(f"SELECT {columns} FROM {table}" + (f" WHERE {where}" if where else ""))

    def create(self, target: str, content: dict[str, Any]) -> DataFrame:
        return self.sql(f"CREATE {target} CONTENT $content", {"content": content})

    def insert(self, table: str, rows: list[dict[str, Any]]) -> DataFrame:
        return self.sql(f"INSERT INTO {table} $rows", {"rows": rows})

    def update(self, target: str, merge: dict[str, Any], where: str = "") -> DataFrame:
        return self.sql(f"UPDATE {target} MERGE $merge" + (f" WHERE {where}" if where else ""), {"merge": merge})

    def upsert(self, target: str, content: dict[str, Any]) -> DataFrame:
        return self.sql(f"UPSERT {target} CONTENT $content", {"content": content})

    def delete(self, target: str, where: str = "") -> DataFrame:
        return self.sql(f"DELETE {target}" + (f" WHERE {where}" if where else "") + " RETURN BEFORE")

    def run(self, function: str, *args: Any) -> Any:
        names = [f"a{i}" for i in range(len(args))]
        return self.value(f"RETURN {function}({', '.join('$' + n for n in names)})", dict(zip(names, args)))

    def export(self, path: str) -> list[str]:
        """Every table as Parquet below the path; returns the tables' names."""
        for name, t in self.catalog.tables.items():
            t.df().write.mode("overwrite").parquet(f"{path}/{name}")
        return sorted(self.catalog.tables)

    def load(self, path: str, names: list[str]) -> Engine:
        for name in names:
            self.catalog.add_parquet(name, f"{path}/{name}", key="id")
        return self


#: The star schema's links: a column holds keys of a table.
LINKS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}


def star(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the star schema's Parquet files; line items are edges from orders to parts."""
    e = Engine(spark)
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        t = e.catalog.add_parquet(name, f"{sf_dir}/{name}.parquet", key=KEYS.get(name), links=LINKS.get(name))
        t.info["plain_key"] = True
    line = e.catalog.tables["lineitem"]
    line.edge = Edge("l_orderkey", "orders", "l_partkey", "part")
    line.order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    e.catalog.tables["labels"].order = ["doc_id"]
    e.catalog.tables["conversations"].order = ["conv_id", "turn"]
    return e
