"""Differences of documents as JSON patches (RFC 6902), on JSON text."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import types as T

from omniframe.plans.values import Val

if TYPE_CHECKING:
    from omniframe.plans.compiler import Scope


def _key(k: str) -> str:
    return k.replace("~", "~0").replace("/", "~1")


def operations(a: Any, b: Any, at: str = "") -> list[dict[str, Any]]:
    """The operations that turn a into b."""
    if a == b and type(a) is type(b):
        return []
    if isinstance(a, dict) and isinstance(b, dict):
        out = [{"op": "remove", "path": f"{at}/{_key(k)}"} for k in sorted(a) if k not in b]
        for k in sorted(b):
            out += operations(a[k], b[k], f"{at}/{_key(k)}") if k in a else [{"op": "add", "path": f"{at}/{_key(k)}", "value": b[k]}]
        return out
    if isinstance(a, list) and isinstance(b, list):
        out = []
        for i in range(min(len(a), len(b))):
            out += operations(a[i], b[i], f"{at}/{i}")
        out += [{"op": "remove", "path": f"{at}/{i}"} for i in range(len(a) - 1, len(b) - 1, -1)]
        return out + [{"op": "add", "path": f"{at}/{i}", "value": b[i]} for i in range(len(a), len(b))]
    return [{"op": "replace", "path": at, "value": b}]


def applied(doc: Any, ops: list[dict[str, Any]]) -> Any:
    """The document after all operations, in order."""
    doc = json.loads(json.dumps(doc))

    def find(path: str) -> tuple[Any, str]:
        keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]
        at = doc
        for k in keys[:-1]:
            at = at[int(k)] if isinstance(at, list) else at.setdefault(k, {})
        return at, keys[-1]

    def read(path: str) -> Any:
        at, k = find(path)
        return at[int(k)] if isinstance(at, list) else at[k]

    def put(path: str, value: Any, insert: bool) -> None:
        at, k = find(path)
        if isinstance(at, list):
            i = len(at) if k == "-" else int(k)
            at[i : i + (not insert)] = [value]
        else:
            at[k] = value

    for o in ops:
        op, path = o["op"], o.get("path", "")
        if path == "" and op in ("add", "replace"):
            doc = o["value"]
        elif op in ("add", "replace", "change"):
            put(path, o["value"], op == "add")
        elif op in ("move", "copy"):
            value = json.loads(json.dumps(read(o["from"])))
            if op == "move":
                at, k = find(o["from"])
                del at[int(k) if isinstance(at, list) else k]
            put(path, value, True)
        elif op == "remove":
            at, k = find(path)
            if isinstance(at, list):
                del at[int(k)]
            else:
                at.pop(k, None)
        elif op == "test" and read(path) != o["value"]:
            raise ValueError(f"test failed at {path}")
    return doc


def diff_text(a: str, b: str) -> str:
    return json.dumps(operations(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)


def patch_text(a: str, ops: str) -> str:
    return json.dumps(applied(json.loads(a), json.loads(ops)), separators=(",", ":"), ensure_ascii=False)


UDFS = {"diff_text": (diff_text, "string"), "patch_text": (patch_text, "string")}


def json_sql(v: Val) -> str:
    if v.family in ("object", "array"):
        return f"to_json({v.sql})"
    return f"substr(to_json(array({v.sql})), 2, length(to_json(array({v.sql}))) - 2)"


def build(name: str, scope: Scope, args: list[Val]) -> Val:
    from omniframe.functions.python_udfs import register

    f = register(scope, {"value_diff": "diff_text", "value_patch": "patch_text"}[name])
    second = args[1].sql if name == "value_patch" and args[1].family == "string" else json_sql(args[1])
    return Val(f"{f}({json_sql(args[0])}, {second})", T.StringType())
