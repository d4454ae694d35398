"""Aggregates and groups as plain values that become columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

NATIVE = ("count", "sum", "avg", "min", "max", "stddev", "concat_str")
SPATIAL = ("envelope", "convex_hull", "union_geom")


@dataclass(frozen=True)
class Agg:
    """One aggregate; ``column`` is None for counts, ``arg`` is a delimiter."""

    kind: str
    column: str | None = None
    name: str | None = None
    arg: str | None = None

    def alias(self, name: str) -> "Agg":
        return replace(self, name=name)

    @property
    def output(self) -> str:
        return self.name or {"envelope": "mbr", "union_geom": "the_geom", "concat_str": "concated"}.get(self.kind, self.kind)

    def native(self) -> Column:
        c = F.col(f"`{self.column}`") if self.column else None
        if self.kind == "count":
            return F.count(F.lit(1)).alias(self.output)
        if self.kind == "concat_str":  # in sorted order, so that it is the same each time
            return F.array_join(F.sort_array(F.collect_list(c.cast("string"))), self.arg or "").alias(self.output)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev}[self.kind](c).alias(self.output)


def count() -> Agg:
    return Agg("count")


def _of(kind: str):
    def make(column: str) -> Agg:
        return Agg(kind, column)

    make.__name__ = kind
    make.__doc__ = f"{kind} of a column, nulls left out."
    return make


sum_, avg, min_, max_, stddev, envelope, convex_hull, union_geom = map(_of, ("sum", "avg", "min", "max", "stddev", "envelope", "convex_hull", "union_geom"))


def concat_str(column: str, delim: str) -> Agg:
    return Agg("concat_str", column, arg=delim)


def _csv(v: str | Sequence[str] | None) -> list[str]:
    return [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v or [])


@dataclass(frozen=True)
class Group:
    """Keys, tags (columns that follow from the keys) and an order such as ``"a, b:desc"``.

    An order item may end in ``:first`` or ``:last`` for nulls, which holds for the
    ascending order and turns round with ``desc``.
    """

    keys: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)

    @staticmethod
    def of(keys: "str | Sequence[str] | Group", tags: str | Sequence[str] | None = None, order: str | Sequence[str] | None = None) -> "Group":
        return keys if isinstance(keys, Group) else Group(_csv(keys), _csv(tags), _csv(order))

    def order_columns(self) -> list[Column]:
        out = []
        for item in self.order:
            name, *marks = (x.strip() for x in item.split(":"))
            low = [m.lower() for m in marks]
            desc = any(m in ("d", "desc", "descending") for m in low)
            last = any(m in ("last", "nulls_last") for m in low)
            c = F.col(f"`{name}`")
            if desc:
                out.append(c.desc_nulls_first() if last else c.desc_nulls_last())
            else:
                out.append(c.asc_nulls_last() if last else c.asc_nulls_first())
        return out
