"""What queries parse to."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    pass


@dataclass
class Lit(Node):
    value: Any
    kind: str = ""  # "", none, duration, datetime, uuid, regex, bytes, decimal, file


@dataclass
class Param(Node):
    name: str


@dataclass
class RecordId(Node):
    table: str
    key: Any  # a Node, or Range


@dataclass
class Range(Node):
    begin: Node | None
    end: Node | None
    skip: bool = False
    inclusive: bool = False


@dataclass
class Mock(Node):
    table: str
    begin: int
    end: int


@dataclass
class Array(Node):
    items: list[Node]


@dataclass
class Obj(Node):
    items: list[tuple[str, Node]]


@dataclass
class Call(Node):
    name: str
    args: list[Node]


@dataclass
class Closure(Node):
    params: list[str]
    body: Node


@dataclass
class Un(Node):
    op: str
    arg: Node


@dataclass
class Bin(Node):
    op: str
    left: Node
    right: Node
    extra: Any = None


@dataclass
class Cast(Node):
    kind: str
    arg: Node


@dataclass
class If(Node):
    branches: list[tuple[Node, Node]]
    other: Node | None


@dataclass
class Block(Node):
    body: list[Node]


@dataclass
class Part:
    kind: str  # field index all last first flatten where destructure optional method graph recurse
    value: Any = None
    args: Any = None


@dataclass
class Graph:
    direction: str  # out in both ref
    tables: list[str]
    where: Node | None = None
    fields: Any = None
    alias: str | None = None
    order: list = field(default_factory=list)
    limit: Node | None = None
    start: Node | None = None


@dataclass
class Recurse:
    least: int
    most: int | None
    instruction: str | None  # collect, path, shortest
    target: Node | None
    inclusive: bool
    parts: list[Part]


@dataclass
class Idiom(Node):
    start: Node | None
    parts: list[Part]


@dataclass
class Column:
    expr: Node | None  # None: *
    alias: str | None


@dataclass
class Order:
    expr: Node | None  # None: RAND()
    descending: bool = False
    collate: bool = False
    numeric: bool = False


@dataclass
class Select(Node):
    columns: list[Column] = field(default_factory=list)
    value: bool = False
    omit: list[Node] = field(default_factory=list)
    only: bool = False
    sources: list[Node] = field(default_factory=list)
    where: Node | None = None
    split: list[Node] = field(default_factory=list)
    group: list[Node] | None = None  # []: GROUP ALL
    order: list[Order] = field(default_factory=list)
    limit: Node | None = None
    start: Node | None = None
    fetch: list[Node] = field(default_factory=list)
    version: Node | None = None
    timeout: Node | None = None
    explain: str | None = None


@dataclass
class Statement(Node):
    """Anything else: kind, and its clauses by name."""

    kind: str
    clauses: dict[str, Any] = field(default_factory=dict)
