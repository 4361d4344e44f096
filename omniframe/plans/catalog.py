"""What the planner knows of tables, links, edges, fields, analyzers and functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Edge:
    """An edge table: from_col holds keys of from_table, to_col of to_table."""

    from_col: str
    from_table: str
    to_col: str
    to_table: str


@dataclass
class Table:
    name: str
    load: Callable[[], DataFrame]
    key: str | None = None
    links: dict[str, str] = field(default_factory=dict)
    edge: Edge | None = None
    order: list[str] = field(default_factory=list)
    versions: list[tuple[float, DataFrame]] = field(default_factory=list)
    info: dict[str, Any] = field(default_factory=dict)

    def df(self) -> DataFrame:
        return self.load()

    @property
    def sort(self) -> list[str]:
        return self.order or ([self.key] if self.key else [])


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    analyzers: dict[str, dict[str, Any]] = field(default_factory=dict)
    functions: dict[str, dict[str, Any]] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    objects: dict[str, dict[str, Any]] = field(default_factory=dict)
    session: dict[str, str] = field(default_factory=lambda: {"ns": "main", "db": "main"})
    udfs: dict[str, Any] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"there is no table {name}")
        return self.tables[name]

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame], key: str | None = None, links: dict[str, str] | None = None, edge: Edge | None = None, order: list[str] | None = None) -> Table:
        load = (lambda: source) if isinstance(source, DataFrame) else source
        t = Table(name, load, key, dict(links or {}), edge, list(order or []))
        self.tables[name] = t
        return t

    def add_parquet(self, name: str, path: str, **more: Any) -> Table:
        """A table of files; zone-less timestamps are read as UTC instants."""
        held: list[DataFrame] = []

        def load() -> DataFrame:
            if not held:
                df = self.spark.read.parquet(path)
                plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
                held.append(df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df)
            return held[0]

        return self.add(name, load, **more)
