"""Typed SQL expressions and the language's rules for truth, order and arithmetic.

An expression compiles to a piece of Spark SQL with its type. A missing field
and NULL are both SQL NULL. Comparisons never give NULL: NULL sorts before
everything, as the language orders its values. A whole number divided by a
column that is zero gives NULL, since a typed column cannot hold NaN beside whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Val:
    """sql, its type; literal: no column in it; link: the table that its record ids point to."""

    sql: str
    type: T.DataType
    literal: bool = False
    link: str | None = None
    tag: str = ""  # regex, range

    @property
    def family(self) -> str:
        t = self.type
        if isinstance(t, NUMBERS):
            return "number"
        for kind, name in ((T.StringType, "string"), (T.BooleanType, "bool"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.DateType, "datetime"), (T.DayTimeIntervalType, "duration"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"), (T.BinaryType, "bytes"), (T.NullType, "none")):
            if isinstance(t, kind):
                return name
        return t.simpleString()


#: The order of values of different kinds.
RANK = {"none": 0, "bool": 2, "number": 3, "string": 4, "duration": 5, "datetime": 6, "array": 8, "object": 10, "bytes": 12}


def truthy(v: Val) -> str:
    """A condition that is never NULL."""
    f, s = v.family, v.sql
    if f == "bool":
        return s if v.literal else f"coalesce({s}, false)"
    if f == "number":
        return f"coalesce({s} <> 0, false)"
    if f == "string":
        return f"coalesce({s} <> '', false)"
    if f == "array" or isinstance(v.type, T.MapType):
        return f"coalesce(size({s}) > 0, false)"
    if f == "bytes":
        return f"coalesce(octet_length({s}) > 0, false)"
    if f == "none":
        return "false"
    if f == "duration":
        return f"coalesce({s} <> INTERVAL '0' SECOND, false)"
    return f"({s} IS NOT NULL)"


def equal(a: Val, b: Val) -> str:
    if b.tag == "regex":
        return f"coalesce({a.sql} rlike {b.sql}, false)"
    if a.tag == "regex":
        return f"coalesce({b.sql} rlike {a.sql}, false)"
    if "none" in (a.family, b.family):
        other = a if b.family == "none" else b
        return "true" if other.family == "none" else f"({other.sql} IS NULL)"
    if a.family != b.family:
        return "false"
    return f"({a.sql} <=> {b.sql})"


def compare(op: str, a: Val, b: Val, pushable: bool = False) -> str:
    """a op b in the order of all values; pushable: NULL may stand for false, so a scan can use it."""
    if "none" in (a.family, b.family) or a.family != b.family:
        if a.family == b.family:
            return "true" if "=" in op else "false"
        if b.family == "none":
            return {"<": "false", "<=": f"({a.sql} IS NULL)", ">": f"({a.sql} IS NOT NULL)", ">=": "true"}[op]
        if a.family == "none":
            return {">": "false", ">=": f"({b.sql} IS NULL)", "<": f"({b.sql} IS NOT NULL)", "<=": "true"}[op]
        low = RANK.get(a.family, 9) < RANK.get(b.family, 9)
        return "true" if low == (op[0] == "<") else "false"
    plain = f"{a.sql} {op} {b.sql}"
    if b.literal and op[0] == ">" or a.literal and op[0] == "<":
        return f"({plain})" if pushable else f"coalesce({plain}, false)"
    if b.literal:  # NULL is below every value
        return f"({plain} OR {a.sql} IS NULL)" if pushable else f"coalesce({plain}, true)"
    if a.literal:
        return f"({plain} OR {b.sql} IS NULL)" if pushable else f"coalesce({plain}, true)"
    strict = {"<": f"{a.sql} IS NULL AND {b.sql} IS NOT NULL", "<=": f"{a.sql} IS NULL", ">": f"{b.sql} IS NULL AND {a.sql} IS NOT NULL", ">=": f"{b.sql} IS NULL"}[op]
    return f"coalesce({plain}, {strict})"


def arithmetic(op: str, a: Val, b: Val) -> str:
    fa, fb = a.family, b.family
    if op == "+":
        if fa == fb == "string":
            return f"concat({a.sql}, {b.sql})"
        if fa == fb == "array":
            return f"concat({a.sql}, {b.sql})"
        if fa == fb == "object" and isinstance(a.type, T.MapType):
            return f"map_concat(map_filter({a.sql}, (k, v) -> not map_contains_key({b.sql}, k)), {b.sql})"
        if fa == "array":
            return f"array_append({a.sql}, {b.sql})"
    if op == "-" and fa == "array":
        other = b.sql if fb == "array" else f"array({b.sql})"
        return f"filter({a.sql}, x -> not array_contains({other}, x))"
    if op == "/":
        if isinstance(a.type, WHOLE) and isinstance(b.type, WHOLE):
            if b.sql in ("0L", "0"):
                return "double('NaN')"
            if b.sql.strip("(-L)").isdigit():
                return f"({a.sql} div {b.sql})"
            return f"(CASE WHEN {b.sql} = 0 THEN NULL ELSE {a.sql} div {b.sql} END)"
        if fa == fb == "number":
            x, y = f"double({a.sql})", f"double({b.sql})"
            return f"(CASE WHEN {y} = 0 THEN (CASE WHEN {x} = 0 OR isnan({x}) THEN double('NaN') WHEN {x} > 0 THEN double('Infinity') ELSE double('-Infinity') END) ELSE {x} / {y} END)"
    if op == "%":
        return f"(CASE WHEN {b.sql} = 0 THEN NULL ELSE {a.sql} % {b.sql} END)"
    if op == "**":
        p = f"pow({a.sql}, {b.sql})"
        return f"bigint({p})" if isinstance(a.type, WHOLE) and isinstance(b.type, WHOLE) else p
    return f"({a.sql} {op} {b.sql})"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
