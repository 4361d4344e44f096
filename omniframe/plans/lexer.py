"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    """The text is not a query of the language."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, param, string, number, duration, regex, op, end
    text: str
    value: object
    at: int
    glued: bool  # no white space before it


UNIT_NANOS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
OPERATORS = sorted(
    "<-> <- -> <~ <| |> <= >= == != *= ?= ?: ?? ?. ..= >..= >.. ... .. ** && || @@ += -= +?= ∈ ∉ ∋ ∌ ⊆ ⊂ ⊄ ⊇ ⊃ ⊅ × ÷ ( ) [ ] { } , ; : . < > = + - * / % ! ? | @ $ & ~".split(),
    key=len,
    reverse=True,
)
SPACE = re.compile(r"(?:\s+|--[^\n]*|//[^\n]*|\#[^\n]*|/\*.*?\*/)+", re.S)
STRING = re.compile(r"(?P<prefix>[durbsf]?)(?P<q>['\"])(?P<body>(?:\\.|(?!(?P=q)).)*)(?P=q)", re.S)
DURATION = re.compile(r"(?:\d+(?:ns|us|µs|ms|[smhdwy]))+(?!\w)")
NUMBER = re.compile(r"\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:f|dec)?(?!\w)")
WORD = re.compile(r"[A-Za-z_]\w*(?:(?:::)[A-Za-z_]\w*)*")
QUOTED = re.compile(r"`((?:\\.|[^`])*)`|⟨([^⟩]*)⟩")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def unescape(body: str) -> str:
    return re.sub(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:].strip("{}"), 16)) if m[1][0] == "u" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), body, flags=re.S)


def nanos(text: str) -> int:
    return sum(int(n) * UNIT_NANOS[u] for n, u in re.findall(r"(\d+)(ns|us|µs|ms|[smhdwy])", text))


REGEX = re.compile(r"/((?:\\.|[^/\\\n])+)/")
#: Words after which a value is wanted, so that a slash begins a pattern.
BEFORE_VALUES = frozenset("AND OR WHERE IN INSIDE NOT CONTAINS CONTAINSNOT IS RETURN SELECT VALUE THEN ELSE BY".split())


def wants_value(out: list[Token]) -> bool:
    if not out:
        return True
    t = out[-1]
    if t.kind == "op":
        return t.text not in (")", "]", "}", "*", "?", "@")
    return t.kind == "word" and t.text.upper() in BEFORE_VALUES


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, n = 0, len(text)
    while True:
        m = SPACE.match(text, at)
        glued = m is None
        at = m.end() if m else at
        if at >= n:
            out.append(Token("end", "", None, at, glued))
            return out
        if text[at] == "/" and wants_value(out) and (m := REGEX.match(text, at)):
            out.append(Token("regex", m[0], m[1].replace("\\/", "/"), at, glued))
        elif m := STRING.match(text, at):
            out.append(Token("string", m["prefix"] or "s", unescape(m["body"]), at, glued))
        elif m := DURATION.match(text, at):
            out.append(Token("duration", m[0], nanos(m[0]), at, glued))
        elif m := NUMBER.match(text, at):
            raw = m[0].replace("_", "")
            if raw.endswith("dec"):
                value: object = ("dec", raw[:-3])
            elif raw.endswith("f"):
                value = float(raw[:-1])
            else:
                value = float(raw) if re.search("[.eE]", raw) else int(raw)
            out.append(Token("number", m[0], value, at, glued))
        elif m := re.compile(r"\$[A-Za-z_]\w*").match(text, at):
            out.append(Token("param", m[0], m[0][1:], at, glued))
        elif m := re.compile(r"@\d+@|@(?:AND|OR)@", re.I).match(text, at):
            out.append(Token("op", "@@", m[0][1:-1], at, glued))
        elif m := WORD.match(text, at):
            out.append(Token("word", m[0], m[0], at, glued))
        elif m := QUOTED.match(text, at):
            out.append(Token("word", "`", m[1] if m[1] is not None else m[2], at, glued))
        else:
            op = next((o for o in OPERATORS if text.startswith(o, at)), None)
            if op is None:
                raise QuerySyntaxError(f"unexpected {text[at]!r} at {at}")
            out.append(Token("op", op, op, at, glued))
            at += len(op)
            continue
        at = m.end()
