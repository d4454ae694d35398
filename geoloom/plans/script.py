"""Row scripts, compiled to Catalyst expressions.

A subset of a Java-like language: arithmetic, comparisons, && || !, ?:, string
methods, Math.*, String.format, ST_* functions, assignments (= += -= *= /=), ``;``
sequences and if / else if / else blocks. Nothing is interpreted at run time; what
the subset lacks is an error when the pipeline is built.

Where an evaluation would fail (a bad cast, a division by zero) the result is NULL,
so a filter drops the row. ``substring`` past a string's end gives a shorter string.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+|\d+)[LlFfDd]?|('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|([A-Za-z_\u0080-\uffff$][\w$\u0080-\uffff]*)|(==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|[-+*/%<>=!(){};,.?:\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class ScriptError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    out, pos = [], 0
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ScriptError(f"bad script at {text[pos:pos + 20]!r}")
        kind = next(k for k, v in zip(("number", "string", "name", "op"), m.groups()) if v is not None)
        out.append((kind, m[m.lastindex]))
        pos = m.end()
    return [*out, ("end", "")]


class _Value:
    """A column and, where known, its kind: "num", "str", "bool"."""

    def __init__(self, column: Column, kind: str | None = None) -> None:
        self.column, self.kind = column, kind


def _kind(t: T.DataType | None) -> str | None:
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "num" if isinstance(t, T.NumericType) else None


class _Parser:
    def __init__(self, text: str, schema: dict[str, T.DataType], args: dict[str, Any] | None, functions: dict[str, Callable[..., Column]] | None) -> None:
        self.t, self.at = _tokens(text), 0
        self.env = {k: _Value(F.col(f"`{k}`"), _kind(t)) for k, t in schema.items()}
        self.env |= {k: _Value(F.lit(v), "str" if isinstance(v, str) else "num" if isinstance(v, (int, float)) else None) for k, v in (args or {}).items()}
        self.functions = {k.lower(): f for k, f in (functions or {}).items()}
        self.assigned: dict[str, _Value] = {}

    def peek(self, k: int = 0) -> str:
        kind, v = self.t[min(self.at + k, len(self.t) - 1)]
        return v if kind in ("op", "name") else ""

    def take(self, want: str = "") -> str:
        kind, v = self.t[self.at]
        if want and (v != want or kind == "string"):
            raise ScriptError(f"expected {want!r}, found {v!r}")
        self.at += 1
        return v

    # statements
    def script(self) -> None:
        while self.t[self.at][0] != "end":
            self.statement()

    def statement(self) -> None:
        if self.peek() == ";":
            self.take()
        elif self.peek() == "if":
            self.branch()
        elif self.peek() == "{":
            self.block()
        elif self.t[self.at][0] == "name" and self.peek(1) in ("=", "+=", "-=", "*=", "/="):
            name, op = self.take(), self.take()
            value = self.expression()
            if op != "=":
                value = self.binary(op[0], self.lookup(name), value)
            self.assign(name, value)
            if self.peek() == ";":
                self.take()
        else:
            raise ScriptError(f"not a statement at {self.peek()!r}")

    def assign(self, name: str, value: _Value) -> None:
        name = next((k for k in self.env if k.lower() == name.lower()), name)
        self.env[name] = self.assigned[name] = value

    def block(self) -> None:
        if self.peek() != "{":
            return self.statement()
        self.take("{")
        while self.peek() != "}":
            self.statement()
        self.take("}")

    def branch(self) -> None:
        self.take("if")
        self.take("(")
        test = self.expression().column
        self.take(")")
        env, assigned = dict(self.env), dict(self.assigned)
        self.block()
        then_env, then_set = self.env, self.assigned
        self.env, self.assigned = dict(env), dict(assigned)
        if self.peek() == "else":
            self.take()
            self.block()
        for name in [n for n in {**then_set, **self.assigned} if then_set.get(n) is not assigned.get(n) or self.assigned.get(n) is not assigned.get(n)]:
            none = _Value(F.lit(None))
            a, b = then_env.get(name, env.get(name, none)), self.env.get(name, env.get(name, none))
            self.assign(name, _Value(F.when(test, a.column).otherwise(b.column), a.kind or b.kind))

    def lookup(self, name: str) -> _Value:
        if name in self.env:
            return self.env[name]
        low = [k for k in self.env if k.lower() == name.lower()]
        if len(low) != 1:
            raise ScriptError(f"unknown name {name!r}")
        return self.env[low[0]]

    # expressions, by precedence
    _LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))

    def expression(self) -> _Value:
        test = self.level(0)
        if self.peek() == "?":
            self.take()
            a = self.expression()
            self.take(":")
            b = self.expression()
            return _Value(F.when(test.column, a.column).otherwise(b.column), a.kind or b.kind)
        return test

    def level(self, k: int) -> _Value:
        if k == len(self._LEVELS):
            return self.unary()
        out = self.level(k + 1)
        while self.peek() in self._LEVELS[k] and self.t[self.at][0] == "op":
            out = self.binary(self.take(), out, self.level(k + 1))
        return out

    def binary(self, op: str, a: _Value, b: _Value) -> _Value:
        x, y = a.column, b.column
        if op in ("==", "!="):  # null equals null alone
            if "num" in (a.kind, b.kind) and "str" in (a.kind, b.kind):
                x, y = x.try_cast("double"), y.try_cast("double")
            return _Value(x.eqNullSafe(y) if op == "==" else ~x.eqNullSafe(y), "bool")
        if op in ("||", "&&"):
            return _Value(x | y if op == "||" else x & y, "bool")
        if op == "+" and "str" in (a.kind, b.kind):
            return _Value(F.concat(x.cast("string"), y.cast("string")), "str")
        if a.kind == "str" and (op in "+-*/%" or b.kind == "num"):
            x = x.try_cast("double")
        if b.kind == "str" and (op in "+-*/%" or a.kind == "num"):
            y = y.try_cast("double")
        if op in ("<", "<=", ">", ">="):
            return _Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
        return _Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[op](x, y), "num")

    def unary(self) -> _Value:
        if self.peek() == "!" and self.t[self.at][0] == "op":
            self.take()
            return _Value(~self.unary().column, "bool")
        if self.peek() == "-" and self.t[self.at][0] == "op":
            self.take()
            return _Value(-self.unary().column, "num")
        return self.postfix(self.primary())

    def arguments(self) -> list[_Value]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def primary(self) -> _Value:
        kind, v = self.t[self.at]
        if kind == "number":
            self.at += 1
            return _Value(F.lit(float(v) if re.search(r"[.eE]", v) else int(v)), "num")
        if kind == "string":
            self.at += 1
            return _Value(F.lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1])), "str")
        if v == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        if kind != "name":
            raise ScriptError(f"unexpected {v!r}")
        self.at += 1
        if v in ("true", "false", "null"):
            return _Value(F.lit({"true": True, "false": False, "null": None}[v]), None if v == "null" else "bool")
        if v in ("Math", "String") and self.peek() == ".":
            self.take()
            return self.static(v, self.take(), self.arguments())
        if self.peek() == "(":
            args = self.arguments()
            f = self.functions.get(v.lower())
            if f is None:
                raise ScriptError(f"unknown function {v!r}")
            return _Value(f(*[a.column for a in args]))
        return self.lookup(v)

    def static(self, owner: str, name: str, args: list[_Value]) -> _Value:
        c = [a.column for a in args]
        if owner == "String" and name == "format":
            return _Value(F.format_string(self._literal(args[0]), *c[1:]), "str")
        if owner == "String" and name == "valueOf":
            return _Value(c[0].cast("string"), "str")
        known = {"max": F.greatest, "min": F.least, "abs": F.abs, "sqrt": F.sqrt, "pow": F.pow, "floor": F.floor, "ceil": F.ceil, "round": lambda x: F.floor(x + 0.5), "log": F.log, "exp": F.exp, "sin": F.sin, "cos": F.cos}
        if owner == "Math" and name in known:
            return _Value(known[name](*c), "num")
        raise ScriptError(f"unknown function {owner}.{name}")

    def _literal(self, v: _Value) -> str:
        for kind, text in reversed(self.t[: self.at]):
            if kind == "string" and v.kind == "str":
                first = [x for k, x in self.t[: self.at] if k == "string"]
                return re.sub(r"\\(.)", r"\1", first[-1][1:-1]) if len(first) == 1 else next(x[1:-1] for x in first if "%" in x)
        raise ScriptError("String.format needs a literal format")

    def postfix(self, v: _Value) -> _Value:
        while self.peek() in (".", "["):
            if self.take() == "[":
                at = self.expression()
                self.take("]")
                v = _Value(F.get(v.column, at.column.cast("int")))
                continue
            name = self.take()
            if self.peek() != "(":
                v = _Value(v.column.getField(name))
                continue
            args = [a.column for a in self.arguments()]
            v = self.method(v, name, args)
        return v

    def method(self, v: _Value, name: str, args: list[Column]) -> _Value:
        c = v.column
        if name == "substring":
            start = args[0].cast("int")
            return _Value(F.substring(c, start + 1, (args[1].cast("int") - start) if len(args) > 1 else F.char_length(c)), "str")
        if name in ("getX", "getY"):
            return _Value(c.getField(name[-1].lower()), "num")
        known: dict[str, tuple[Callable[..., Column], str]] = {
            "startsWith": (F.startswith, "bool"), "endsWith": (F.endswith, "bool"), "contains": (F.contains, "bool"), "equals": (lambda a, b: a.eqNullSafe(b), "bool"),
            "length": (F.char_length, "num"), "size": (F.size, "num"), "trim": (F.trim, "str"), "toUpperCase": (F.upper, "str"), "toLowerCase": (F.lower, "str"),
            "isEmpty": (lambda a: a == "", "bool"), "indexOf": (lambda a, b: F.instr(a, b) - 1, "num"), "replace": (F.replace, "str"), "concat": (F.concat, "str"), "toString": (lambda a: a.cast("string"), "str"),
            "intValue": (lambda a: a.cast("int"), "num"), "doubleValue": (lambda a: a.cast("double"), "num"),
        }
        if name not in known:
            raise ScriptError(f"unknown method {name!r}")
        f, kind = known[name]
        return _Value(f(c, *args), kind)


def expression(text: str, schema: dict[str, T.DataType], args: dict[str, Any] | None = None, functions: dict[str, Callable[..., Column]] | None = None) -> Column:
    """One expression; a trailing ``;`` and an assignment before it are allowed."""
    p = _Parser(text, schema, args, functions)
    if p.t[0][0] == "name" and p.peek(1) == "=":
        p.script()
        return list(p.assigned.values())[-1].column
    out = p.expression()
    while p.peek() == ";":
        p.take()
    if p.t[p.at][0] != "end":
        raise ScriptError(f"unexpected {p.peek()!r} after the expression")
    return out.column


def statements(text: str, schema: dict[str, T.DataType], args: dict[str, Any] | None = None, functions: dict[str, Callable[..., Column]] | None = None) -> dict[str, Column]:
    """The columns that a script assigns, each as one expression over the row before it."""
    p = _Parser(text, schema, args, functions)
    p.script()
    return {k: v.column for k, v in p.assigned.items()}
