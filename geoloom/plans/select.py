"""The column selection language.

    item(, item)*
    item := [ns.] ( *[-{a,b}] | {a [as x], ...} | a [as x] )

``ns`` is ``left`` or ``right`` in joins. A selection is resolved against the
schemas when a pipeline is built; unknown and repeated names are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"\s*([\w$\u0080-\uffff]+|[{}.,*-])")


@dataclass(frozen=True)
class Selected:
    namespace: str
    column: str
    alias: str


def parse(text: str, schemas: dict[str, list[str]]) -> list[Selected]:
    """schemas: column names by namespace; "" stands for names without one."""
    tokens, pos = [], 0
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"bad selection at {text[pos:pos + 20]!r}")
        tokens.append(m[1])
        pos = m.end()
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal at
        t = peek()
        if not t or (want and t != want):
            raise ValueError(f"expected {want or 'a name'} in selection {text!r}")
        at += 1
        return t

    def names_of(ns: str) -> list[str]:
        if ns in schemas:
            return schemas[ns]
        if ns == "":  # every namespace
            return [c for s in schemas.values() for c in s]
        raise ValueError(f"unknown namespace {ns!r} in {text!r}")

    def one(ns: str, name: str) -> Selected:
        space = ns
        if ns == "" and "" not in schemas:
            owners = [k for k, v in schemas.items() if name in v]
            if len(owners) != 1:
                raise ValueError(f"column {name!r} is {'ambiguous' if owners else 'unknown'}")
            space = owners[0]
        found = next((c for c in names_of(space) if c == name), None) or next((c for c in names_of(space) if c.lower() == name.lower()), None)
        if found is None:
            raise ValueError(f"unknown column {name!r} in {text!r}")
        alias = found
        if peek().lower() == "as":
            take()
            alias = take()
        return Selected(space, found, alias)

    def braces() -> list[str]:
        take("{")
        out = [take()]
        while peek() == ",":
            take(",")
            out.append(take())
        take("}")
        return out

    out: list[Selected] = []
    while True:
        ns = ""
        if at + 1 < len(tokens) and tokens[at + 1] == "." and peek() in schemas:
            ns = take()
            take(".")
        if peek() == "*":
            take("*")
            gone: list[str] = []
            if peek() == "-":
                take("-")
                gone = [x.lower() for x in braces()]
            spaces = [ns] if ns or "" in schemas else list(schemas)
            for s in spaces:
                if missing := set(gone) - {c.lower() for c in names_of(s)}:
                    raise ValueError(f"unknown columns {sorted(missing)} in {text!r}")
                out += [Selected(s, c, c) for c in names_of(s) if c.lower() not in gone]
        elif peek() == "{":
            take("{")
            out.append(one(ns, take()))
            while peek() == ",":
                take(",")
                out.append(one(ns, take()))
            take("}")
        else:
            out.append(one(ns, take()))
        if not peek():
            break
        take(",")
    seen = [s.alias.lower() for s in out]
    if twice := sorted({a for a in seen if seen.count(a) > 1}):
        raise ValueError(f"repeated output columns {twice} in {text!r}")
    return out
