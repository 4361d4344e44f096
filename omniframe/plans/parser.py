"""Pratt parser of the query language: text to the nodes of ``ast``."""

from __future__ import annotations

from dataclasses import replace

from omniframe.plans import ast as A
from omniframe.plans.lexer import QuerySyntaxError, Token, tokens

#: Infix operators by spelling: canonical name and binding power.
INFIX = {
    "??": ("??", 1), "?:": ("?:", 1), "||": ("OR", 2), "OR": ("OR", 2), "&&": ("AND", 3), "AND": ("AND", 3),
    "=": ("=", 4), "==": ("==", 4), "IS": ("=", 4), "!=": ("!=", 4), "*=": ("*=", 4), "?=": ("?=", 4),
    "<": ("<", 5), "<=": ("<=", 5), ">": (">", 5), ">=": (">=", 5), "@@": ("@@", 5), "<|": ("<|", 5),
    "IN": ("INSIDE", 5), "INSIDE": ("INSIDE", 5), "∈": ("INSIDE", 5), "NOTINSIDE": ("NOTINSIDE", 5), "∉": ("NOTINSIDE", 5),
    "CONTAINS": ("CONTAINS", 5), "∋": ("CONTAINS", 5), "CONTAINSNOT": ("CONTAINSNOT", 5), "∌": ("CONTAINSNOT", 5),
    "CONTAINSALL": ("CONTAINSALL", 5), "⊇": ("CONTAINSALL", 5), "CONTAINSANY": ("CONTAINSANY", 5), "⊃": ("CONTAINSANY", 5),
    "CONTAINSNONE": ("CONTAINSNONE", 5), "⊅": ("CONTAINSNONE", 5), "ALLINSIDE": ("ALLINSIDE", 5), "⊆": ("ALLINSIDE", 5),
    "ANYINSIDE": ("ANYINSIDE", 5), "⊂": ("ANYINSIDE", 5), "NONEINSIDE": ("NONEINSIDE", 5), "⊄": ("NONEINSIDE", 5),
    "OUTSIDE": ("OUTSIDE", 5), "INTERSECTS": ("INTERSECTS", 5), "MATCHES": ("@@", 5),
    "+": ("+", 6), "-": ("-", 6), "*": ("*", 7), "×": ("*", 7), "/": ("/", 7), "÷": ("/", 7), "%": ("%", 7), "**": ("**", 8),
}
RANGES = {"..": (False, False), "..=": (False, True), ">..": (True, False), ">..=": (True, True)}
UNARY = 9
STATEMENTS = "SELECT CREATE INSERT UPDATE UPSERT DELETE RELATE LIVE KILL SHOW DEFINE ALTER REMOVE REBUILD INFO LET RETURN IF FOR SLEEP OPTION USE BEGIN CANCEL COMMIT THROW BREAK CONTINUE EXPLAIN ACCESS".split()
CLAUSES = frozenset("FROM WHERE SPLIT GROUP ORDER LIMIT START FETCH VERSION TIMEOUT PARALLEL TEMPFILES EXPLAIN OMIT AS WITH RETURN SET UNSET CONTENT MERGE PATCH REPLACE ON THEN ELSE END AND OR IN INSIDE ASC DESC COLLATE NUMERIC".split())


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.toks, self.i = text, tokens(text), 0

    # tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def next(self) -> Token:
        t = self.tok
        self.i += 1
        return t

    def fail(self, what: str) -> None:
        raise QuerySyntaxError(f"expected {what} at {self.tok.at}, found {self.tok.text or 'the end'!r}: {self.text[max(0, self.tok.at - 30) : self.tok.at + 20]!r}")

    def is_op(self, op: str, k: int = 0) -> bool:
        t = self.peek(k) if k else self.tok
        return t.kind == "op" and t.text == op

    def is_word(self, *names: str, k: int = 0) -> bool:
        t = self.peek(k) if k else self.tok
        return t.kind == "word" and t.text != "`" and t.text.upper() in names

    def op(self, op: str) -> bool:
        if self.is_op(op):
            self.i += 1
            return True
        return False

    def word(self, *names: str) -> str | None:
        if self.is_word(*names):
            return self.next().text.upper()
        return None

    def want(self, op: str) -> None:
        if not self.op(op):
            self.fail(repr(op))

    def want_word(self, *names: str) -> str:
        return self.word(*names) or self.fail(" or ".join(names))

    def name(self) -> str:
        if self.tok.kind != "word":
            self.fail("a name")
        return self.next().value

    # statements

    def query(self) -> list[A.Node]:
        out = []
        while self.tok.kind != "end":
            if self.op(";"):
                continue
            out.append(self.statement())
            if self.tok.kind != "end" and not self.is_op(";"):
                self.fail("';'")
        return out

    def statement(self) -> A.Node:
        from omniframe.plans import statements

        if self.tok.kind == "word" and self.tok.text.upper() in STATEMENTS:
            return statements.parse(self)
        if self.tok.kind == "param" and self.is_op("=", 1):
            name = self.next().value
            self.next()
            return A.Statement("LET", {"name": name, "value": self.statement_value()})
        return A.Statement("RETURN", {"value": self.expr()})

    def statement_value(self) -> A.Node:
        """A statement or an expression, where a value is wanted."""
        if self.is_word("SELECT", "CREATE", "INSERT", "UPDATE", "UPSERT", "DELETE", "RELATE"):
            return self.statement()
        return self.expr()

    def select(self) -> A.Select:
        s = A.Select()
        if self.is_word("VALUE") and self.starts_value(1):
            self.next()
            s.value = True
            s.columns = [A.Column(self.expr(), self.alias())]
        else:
            while True:
                if self.is_op("*") and (self.is_op(",", 1) or self.is_word("FROM", "OMIT", k=1)):
                    self.next()
                    s.columns.append(A.Column(None, None))
                else:
                    s.columns.append(A.Column(self.expr(), self.alias()))
                if not self.op(","):
                    break
        if self.word("OMIT"):
            s.omit = self.several()
        self.want_word("FROM")
        s.only = bool(self.word("ONLY"))
        s.sources = self.several()
        while True:
            if self.word("WITH"):
                if not self.word("NOINDEX"):
                    self.want_word("INDEX")
                    self.several()
            elif self.word("WHERE"):
                s.where = self.expr()
            elif self.word("SPLIT"):
                self.word("ON")
                s.split = self.several()
            elif self.word("GROUP"):
                if self.word("ALL"):
                    s.group = []
                else:
                    self.word("BY")
                    s.group = self.several()
            elif self.word("ORDER"):
                self.word("BY")
                s.order = self.orders()
            elif self.word("LIMIT"):
                self.word("BY")
                s.limit = self.expr()
            elif self.word("START"):
                self.word("AT")
                s.start = self.expr()
            elif self.word("FETCH"):
                s.fetch = self.several()
            elif self.word("VERSION"):
                s.version = self.expr()
            elif self.word("TIMEOUT"):
                s.timeout = self.expr()
            elif self.word("PARALLEL", "TEMPFILES"):
                pass
            elif self.word("EXPLAIN"):
                s.explain = "full" if self.word("FULL") else "plan"
            else:
                return s

    def starts_value(self, k: int) -> bool:
        """Whether a value can begin at the token k ahead, rather than an operator or a clause."""
        t = self.peek(k)
        if t.kind == "op":
            return t.text in ("(", "[", "{", "->", "<-", "<->", "<~", "!", "|")
        if t.kind == "word":
            return t.text.upper() not in INFIX and t.text.upper() not in CLAUSES
        return t.kind != "end"

    def orders(self) -> list[A.Order]:
        out = []
        while True:
            if self.is_word("RAND") and self.is_op("(", 1):
                self.i += 3
                out.append(A.Order(None))
            else:
                o = A.Order(self.expr())
                while w := self.word("COLLATE", "NUMERIC", "ASC", "DESC"):
                    if w == "DESC":
                        o.descending = True
                    elif w != "ASC":
                        setattr(o, w.lower(), True)
                out.append(o)
            if not self.op(","):
                return out

    def alias(self) -> str | None:
        if not self.word("AS"):
            return None
        parts = [self.name()]
        while self.op("."):
            parts.append(self.name())
        return ".".join(parts)

    def several(self) -> list[A.Node]:
        out = [self.expr()]
        while self.op(","):
            out.append(self.expr())
        return out

    # expressions

    def expr(self, least: int = 0) -> A.Node:
        left = self.unary()
        while True:
            found = self.infix()
            if found is None or found[1] < least or found[1] == 0:
                return left
            name, power, skip, negate = found
            self.i += skip
            if name == "<|":
                left = A.Bin("KNN", left, *self.knn())
                continue
            extra = None
            if name == "@@":
                extra = self.toks[self.i - 1].value
            right = self.expr(power + 1)
            if name == "=" and negate:
                name = "!="
            elif negate:
                name = "NOTINSIDE"
            left = A.Bin(name, left, right, extra)

    def infix(self) -> tuple[str, int, int, bool] | None:
        t = self.tok
        if t.kind == "op" and t.text == "@@":
            return "@@", 5, 1, False
        if t.kind == "word" and t.text != "`" and t.text.upper() == "NOT" and self.is_word("IN", k=1):
            return "INSIDE", 5, 2, True
        if t.kind == "word" and t.text != "`" and t.text.upper() == "IS" and self.is_word("NOT", k=1):
            return "=", 4, 2, True
        if t.kind not in ("op", "word") or t.text == "`":
            return None
        key = t.text.upper() if t.kind == "word" else t.text
        if key in INFIX:
            name, power = INFIX[key]
            return name, power, 1, False
        return None

    def knn(self) -> tuple[A.Node, tuple[int, str | int | None, float | None]]:
        k = self.next().value
        how: str | int | None = None
        p = None
        if self.op(","):
            t = self.next()
            how = t.value if t.kind == "number" else str(t.value).lower()
            if how == "minkowski" and self.tok.kind == "number":
                p = float(self.next().value)
            if self.op(","):
                self.next()
        self.want("|>")
        return self.expr(6), (int(k), how, p)

    def unary(self) -> A.Node:
        if self.tok.kind == "op":
            if self.tok.text in ("!", "-", "+"):
                op = self.next().text
                arg = self.expr(UNARY)
                if op == "-" and isinstance(arg, A.Lit) and isinstance(arg.value, (int, float)) and not isinstance(arg.value, bool):
                    return self.postfix(A.Lit(-arg.value, arg.kind))
                return A.Un(op, arg)
            if self.tok.text in RANGES and self.tok.text in ("..", "..="):
                inclusive = self.next().text == "..="
                end = None if self.ends_here() else self.expr(UNARY)
                return A.Range(None, end, False, inclusive)
            if self.tok.text == "<" and self.peek().kind == "word":
                return self.cast()
        left = self.postfix(self.primary())
        if self.tok.kind == "op" and self.tok.text in RANGES:
            skip, inclusive = RANGES[self.next().text]
            end = None if self.ends_here() else self.expr(UNARY)
            return A.Range(left, end, skip, inclusive)
        return left

    def ends_here(self) -> bool:
        t = self.tok
        return t.kind == "end" or t.kind == "op" and t.text in (")", "]", "}", ",", ";", "|") or t.kind == "word" and t.text.upper() in CLAUSES

    def cast(self) -> A.Node:
        self.next()
        depth, kind = 1, []
        while depth:
            t = self.next()
            if t.kind == "end":
                self.fail("'>'")
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    break
            kind.append(str(t.text))
        return A.Cast("".join(kind).lower(), self.expr(UNARY))

    def primary(self) -> A.Node:
        t = self.tok
        if t.kind == "number":
            self.next()
            if isinstance(t.value, tuple):
                return A.Lit(t.value[1], "decimal")
            return A.Lit(t.value)
        if t.kind == "duration":
            self.next()
            return A.Lit(t.value, "duration")
        if t.kind == "string":
            self.next()
            if t.text == "r":
                return Parser(t.value).expr()
            return A.Lit(t.value, {"s": "", "d": "datetime", "u": "uuid", "b": "bytes", "f": "file"}[t.text])
        if t.kind == "regex":
            self.next()
            return A.Lit(t.value, "regex")
        if t.kind == "param":
            self.next()
            if self.is_op("(") and self.tok.glued:
                return A.Call("$" + t.value, self.arguments())
            return A.Param(t.value)
        if t.kind == "op":
            if t.text == "(":
                return self.parenthesis()
            if t.text == "[":
                self.next()
                return A.Array(self.listed("]"))
            if t.text == "{":
                return self.braces()
            if t.text in ("|", "||"):
                return self.closure_or_mock()
            if t.text in ("->", "<-", "<->", "<~"):
                return A.Idiom(None, [])
            if t.text == "@":
                self.next()
                return A.Param("this")
            if t.text == "*":
                self.next()
                return A.Idiom(None, [A.Part("all")])
        if t.kind == "word":
            return self.word_value()
        self.fail("a value")

    def parenthesis(self) -> A.Node:
        self.next()
        if self.tok.kind == "word" and self.tok.text.upper() in STATEMENTS:
            inner = self.statement()
        else:
            inner = self.expr()
            if self.op(","):  # a point: (x, y)
                inner = A.Call("type::point", [A.Array([inner, self.expr()])])
        self.want(")")
        return inner

    def listed(self, end: str) -> list[A.Node]:
        out = []
        while not self.op(end):
            out.append(self.statement_value())
            if not self.op(","):
                self.want(end)
                break
        return out

    def arguments(self) -> list[A.Node]:
        self.want("(")
        return self.listed(")")

    def braces(self) -> A.Node:
        """An object, or a block of statements."""
        a, b = self.peek(), self.peek(2)
        if self.is_op("}", 1):
            self.i += 2
            return A.Obj([])
        if a.kind in ("word", "string", "number") and b.kind == "op" and b.text == ":" and "::" not in a.text:
            self.next()
            items = []
            while not self.op("}"):
                key = str(self.next().value)
                self.want(":")
                items.append((key, self.statement_value()))
                if not self.op(","):
                    self.want("}")
                    break
            return A.Obj(items)
        return self.block()

    def block(self) -> A.Block:
        self.want("{")
        body = []
        while not self.op("}"):
            if self.op(";"):
                continue
            body.append(self.statement())
        return A.Block(body)

    def closure_or_mock(self) -> A.Node:
        if self.is_op("|") and self.peek().kind == "word" and self.is_op(":", 2):
            self.next()
            table = self.name()
            self.want(":")
            lo = self.next().value
            hi = None
            if self.op(".."):
                hi = self.next().value
            self.want("|")
            return A.Mock(table, lo if hi is not None else 1, hi if hi is not None else lo)
        names = []
        if not self.op("||"):
            self.want("|")
            while not self.op("|"):
                names.append(self.next().value)
                if self.op(":"):
                    self.kind()
                self.op(",")
        if self.op("->"):
            self.kind()
        return A.Closure(names, self.block() if self.is_op("{") else self.expr())

    def kind(self) -> str:
        """A type's name, with parameters and alternatives."""
        out = [str(self.next().text)]
        if self.is_op("<"):
            depth = 0
            while True:
                t = self.next()
                depth += (t.text == "<") - (t.text == ">")
                out.append(str(t.text))
                if not depth:
                    break
        while self.is_op("|") and self.peek().kind == "word" and self.text[self.tok.at - 1 : self.tok.at] == " ":
            self.next()
            out.append("|" + self.kind())
        return "".join(out).lower()

    def word_value(self) -> A.Node:
        t = self.next()
        upper = t.text.upper() if t.text != "`" else ""
        if upper in ("TRUE", "FALSE"):
            return A.Lit(upper == "TRUE")
        if upper in ("NULL", "NONE"):
            return A.Lit(None, "none" if upper == "NONE" else "")
        if upper == "NAN":
            return A.Lit(float("nan"))
        if upper == "INFINITY":
            return A.Lit(float("inf"))
        if upper == "IF":
            return self.if_else()
        if upper in ("SELECT", "CREATE", "UPDATE", "UPSERT", "DELETE", "INSERT", "RELATE") and not self.is_op(".") and not self.is_op("="):
            self.i -= 1
            return self.statement()
        if self.is_op("(") and (self.tok.glued or "::" in t.text) and t.text != "`":
            return A.Call(t.value.lower() if not t.value.startswith("fn::") else t.value, self.arguments())
        if self.is_op(":") and self.tok.glued and self.peek().glued and "::" not in t.text:
            return self.record_id(t.value)
        if "::" in t.text:
            return A.Call(t.value.lower(), [])
        return A.Idiom(None, [A.Part("field", t.value)])

    def record_id(self, table: str) -> A.Node:
        self.next()
        if self.is_op("..") or self.is_op("..="):
            return A.RecordId(table, self.unary())
        if self.is_op("[") or self.is_op("{"):
            key: A.Node = self.primary()
        elif self.tok.kind == "word" and self.is_op("(", 1):
            return A.RecordId(table, A.Call("rand::" + self.next().value, self.arguments()))
        else:
            neg = self.op("-")
            t = self.next()
            key = A.Lit(-t.value if neg else t.value)
        if self.tok.kind == "op" and self.tok.text in RANGES and self.tok.glued:
            skip, inclusive = RANGES[self.next().text]
            end = None
            if not self.ends_here() and self.tok.glued:
                end = A.Lit(self.next().value) if self.tok.kind in ("word", "number", "string") else self.primary()
            return A.RecordId(table, A.Range(key, end, skip, inclusive))
        return A.RecordId(table, key)

    def if_else(self) -> A.Node:
        branches, other = [], None
        while True:
            cond = self.expr()
            if self.word("THEN"):
                branches.append((cond, self.statement_value()))
            else:
                branches.append((cond, self.block()))
            if not self.word("ELSE"):
                break
            if self.word("IF"):
                continue
            other = self.block() if self.is_op("{") else self.statement_value()
            break
        self.word("END")
        return A.If(branches, other)

    def postfix(self, left: A.Node) -> A.Node:
        parts: list[A.Part] = []
        while self.tok.kind == "op":
            op = self.tok.text
            if op in (".", "?."):
                if op == "?.":
                    parts.append(A.Part("optional"))
                self.next()
                if self.op("*"):
                    parts.append(A.Part("all"))
                elif self.is_op("{"):
                    parts.append(self.recurse() if self.peek().kind == "number" or self.is_op("..", 1) else self.destructure())
                elif self.is_op("@"):
                    self.next()
                    parts.append(A.Part("repeat"))
                elif self.is_op("("):
                    pass
                else:
                    name = self.name()
                    if self.is_op("(") and self.tok.glued:
                        parts.append(A.Part("method", name.lower(), self.arguments()))
                    else:
                        parts.append(A.Part("field", name))
            elif op == "..." :
                self.next()
                parts.append(A.Part("flatten"))
            elif op == "[" and self.tok.glued:
                self.next()
                if self.op("*"):
                    parts.append(A.Part("all"))
                elif self.op("$"):
                    parts.append(A.Part("last"))
                elif self.word("WHERE") or self.op("?"):
                    parts.append(A.Part("where", self.expr()))
                else:
                    parts.append(A.Part("index", self.expr()))
                self.want("]")
            elif op in ("->", "<-", "<->", "<~"):
                parts.append(self.graph())
            else:
                break
        if not parts:
            return left
        if isinstance(left, A.Idiom):
            return A.Idiom(left.start, left.parts + parts)
        return A.Idiom(left, parts)

    def destructure(self) -> A.Part:
        self.want("{")
        fields = []
        while not self.op("}"):
            name = self.name()
            inner = None
            if self.op(":"):
                inner = self.expr()
            elif self.is_op("."):
                inner = self.postfix(A.Idiom(None, [A.Part("field", name)]))
            fields.append((name, inner))
            if not self.op(","):
                self.want("}")
                break
        return A.Part("destructure", fields)

    def recurse(self) -> A.Part:
        """.{least..most+instruction}(path)"""
        self.want("{")
        least, most = 1, None
        if self.tok.kind == "number":
            least = most = int(self.next().value)
            if self.op(".."):
                most = None
                if self.tok.kind == "number":
                    most = int(self.next().value)
        else:
            self.want("..")
            if self.tok.kind == "number":
                most = int(self.next().value)
        instruction, target, inclusive = None, None, False
        while self.op("+"):
            w = self.name().lower()
            if w == "inclusive":
                inclusive = True
            else:
                instruction = w
                if w == "shortest":
                    self.want("=")
                    target = self.unary()
        self.want("}")
        if self.op("("):
            inner = self.postfix(self.primary() if self.tok.kind == "word" else A.Idiom(None, []))
            if self.is_op("."):
                inner = self.postfix(inner)
            self.want(")")
            parts = inner.parts
        else:
            parts = self.postfix(A.Idiom(None, [])).parts
        return A.Part("recurse", A.Recurse(least, most, instruction, target, inclusive, parts))

    def graph(self) -> A.Part:
        direction = {"->": "out", "<-": "in", "<->": "both", "<~": "ref"}[self.next().text]
        g = A.Graph(direction, [])
        if self.op("("):
            if self.word("SELECT"):
                g.fields = []
                while True:
                    g.fields.append(A.Column(None, None) if self.op("*") else A.Column(self.expr(), self.alias()))
                    if not self.op(","):
                        break
                self.want_word("FROM")
            while True:
                g.tables.append("*" if self.op("?") else self.name())
                if self.is_word("FIELD"):
                    self.next()
                    self.name()
                if not self.op(","):
                    break
            while not self.op(")"):
                if self.word("WHERE"):
                    g.where = self.expr()
                elif self.word("ORDER"):
                    self.word("BY")
                    g.order = self.orders()
                elif self.word("LIMIT"):
                    g.limit = self.expr()
                elif self.word("START"):
                    g.start = self.expr()
                elif self.word("AS"):
                    g.alias = self.name()
                else:
                    self.fail("')'")
        elif self.op("?"):
            g.tables.append("*")
        elif self.is_op("?."):  # any table, and a field after it
            g.tables.append("*")
            self.toks[self.i] = replace(self.tok, text=".")
        else:
            g.tables.append(self.name())
        return A.Part("graph", g)


def parse(text: str) -> list[A.Node]:
    return Parser(text).query()


def parse_expr(text: str) -> A.Node:
    p = Parser(text)
    out = p.statement_value()
    if p.tok.kind != "end":
        p.fail("the end")
    return out
