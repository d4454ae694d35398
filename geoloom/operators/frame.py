"""GeoFrame: a DataFrame with a geometry column and its coordinate reference system.

Every method returns a new frame and only adds to the logical plan, unless its text
says that it runs a job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import st
from ..plans import script as _script
from ..plans import select as _select
from ..plans.aggregate import SPATIAL, Agg, Group, _csv
from ..runtime import ship, spread, table
from . import grid as _grid
from . import quadkey as _quad
from . import sjoin as _sjoin
from .components import components

_TYPES = {"string": "string", "str": "string", "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "double": "double", "float": "float", "short": "smallint", "byte": "tinyint", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "binary": "binary", "geometry": "binary", "point": "struct<x:double,y:double>", "polygon": "binary", "envelope": "struct<xmin:double,xmax:double,ymin:double,ymax:double>", "grid_cell": "struct<x:int,y:int>", "float_array": "array<float>"}
JOIN_TYPES = {"inner": "inner", "left_outer": "left", "left": "left", "right_outer": "right", "right": "right", "full_outer": "full", "full": "full", "semi": "left_semi"}


def parse_columns(decl: str) -> list[tuple[str, str]]:
    """``"a:int,b:string"`` to names and Spark types."""
    out = []
    for part in _csv(decl):
        name, sep, kind = part.partition(":")
        if not sep or kind.strip().lower() not in _TYPES:
            raise ValueError(f"bad column declaration {part!r}")
        out.append((name.strip(), _TYPES[kind.strip().lower()]))
    return out


#: Matches of a row that are melted together.
MATCHES = 256


def _strict(f: Callable, throw: bool) -> Callable:
    return f.strict if throw else f


@dataclass(frozen=True)
class GeoFrame:
    df: DataFrame
    geom: str | None = None
    srid: str | None = None

    def __post_init__(self) -> None:
        if self.geom is not None and self.geom not in self.df.columns:
            raise ValueError(f"no geometry column {self.geom!r}")

    # -- basics
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def _types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema}

    def _with(self, df: DataFrame, geom: str | None = None, srid: str | None = None) -> "GeoFrame":
        g = geom or self.geom
        return GeoFrame(df, g if g in df.columns else None, srid or self.srid)

    def _geometry(self) -> tuple[Column, T.DataType]:
        if not self.geom:
            raise ValueError("the frame has no geometry column")
        ship(self.df.sparkSession)
        return F.col(f"`{self.geom}`"), self.df.schema[self.geom].dataType

    def _wkb(self) -> Column:
        return st.wkb(*self._geometry())

    def with_geometry(self, geom: str, srid: str | None = None) -> "GeoFrame":
        return GeoFrame(self.df, geom, srid or self.srid)

    def apply(self, f: Callable[..., "GeoFrame | DataFrame"], *args: Any) -> "GeoFrame":
        """A user-defined operator over the frame."""
        out = f(self, *args)
        return out if isinstance(out, GeoFrame) else self._with(out)

    derive = apply

    # -- projection and columns
    def project(self, selection: str) -> "GeoFrame":
        picked = _select.parse(selection, {"": self.columns})
        geom = next((s.alias for s in picked if s.column == self.geom), None)
        return GeoFrame(self.df.select(*[F.col(f"`{s.column}`").alias(s.alias) for s in picked]), geom, self.srid)

    def _compiled(self, text: str, args: dict | None) -> dict[str, Column]:
        return _script.statements(text, self._types(), args, st.BY_NAME)

    def _expression(self, text: str, args: dict | None) -> Column:
        ship(self.df.sparkSession)
        return _script.expression(text, self._types(), args, st.BY_NAME)

    def define_column(self, decl: str, script: str | None = None, args: dict | None = None) -> "GeoFrame":
        """Add or replace one column; without a script an existing one is cast and a new one is NULL."""
        cols = parse_columns(decl)
        if len(cols) != 1:
            raise ValueError(f"one column is declared at a time, not {len(cols)}")
        name, kind = cols[0]
        if script is not None:
            value = self._expression(script, args)
        else:
            value = F.col(f"`{name}`") if name in self.columns else F.lit(None)
        return self._with(self.df.withColumn(name, value.cast(kind)))

    def expand(self, decl: str, script: str | None = None, args: dict | None = None) -> "GeoFrame":
        """Add or replace columns; a script assigns to them, then each is cast to its type."""
        cols = parse_columns(decl)
        if script is None:
            return self._with(self.df.withColumns({n: (F.col(f"`{n}`") if n in self.columns else F.lit(None)).cast(t) for n, t in cols}))
        ship(self.df.sparkSession)
        declared = self._types() | {n: T.NullType() for n, _ in cols if n not in self.columns}
        base = self.df.withColumns({n: F.lit(None) for n, _ in cols if n not in self.columns})
        made = _script.statements(script, declared, args, st.BY_NAME)
        kinds = dict(cols)
        out = {n: made.get(n, F.col(f"`{n}`")).cast(t) for n, t in cols}
        out |= {n: c.cast(self.df.schema[n].dataType) for n, c in made.items() if n in self.columns and n not in kinds}
        return self._with(base.withColumns(out))

    def update_script(self, script: str, args: dict | None = None) -> "GeoFrame":
        """Assign to existing columns; the schema stays."""
        ship(self.df.sparkSession)
        made = self._compiled(script, args)
        if unknown := [n for n in made if n not in self.columns]:
            raise ValueError(f"unknown columns {unknown}")
        return self._with(self.df.withColumns({n: c.cast(self.df.schema[n].dataType) for n, c in made.items()}))

    def update_sql(self, column: str, expr: str) -> "GeoFrame":
        return self._with(self.df.withColumn(column, F.expr(expr)))

    def assign_uid(self, column: str = "uid") -> "GeoFrame":
        """A unique number a row, rising within each partition; gaps occur. A partition may have 2^33 rows."""
        return self._with(self.df.withColumn(column, F.monotonically_increasing_id()))

    def fill_na(self, columns: str | Sequence[str], value: Any) -> "GeoFrame":
        return self._with(self.df.na.fill(value, _csv(columns)))

    def sample(self, ratio: float, seed: int | None = None) -> "GeoFrame":
        return self._with(self.df.sample(False, ratio, seed))

    def rescale(self, column: str) -> "GeoFrame":
        """(value - min) / (max - min) as a double; NULL where all values are equal. Runs a job for the bounds."""
        c = F.col(f"`{column}`").cast("double")
        lo, hi = self.df.agg(F.min(c), F.max(c)).first()
        value = F.lit(None).cast("double") if lo is None or lo == hi else (c - F.lit(lo)) / F.lit(hi - lo)
        return self._with(self.df.withColumn(column, value))

    # -- filters
    def filter_script(self, script: str, args: dict | None = None, negated: bool = False) -> "GeoFrame":
        test = F.coalesce(self._expression(script, args), F.lit(False))
        return self._with(self.df.filter(~test if negated else test))

    def filter_sql(self, predicate: str) -> "GeoFrame":
        return self._with(self.df.filter(predicate))

    def filter_spatial(self, key: "tuple[float, float, float, float] | bytes | GeoFrame", relation: str = "intersects", negated: bool = False, dist: float = 0.0) -> "GeoFrame":
        """Rows related to a key: (xmin, ymin, xmax, ymax), WKB, or a frame's first geometry (which runs a job).

        The envelope test comes first and is native. A null geometry is related to
        nothing, and so stays when negated.
        """
        geom, kind = self._geometry()
        if isinstance(key, GeoFrame):
            found = key.df.select(key._wkb().alias("g")).filter("g is not null").first()
            if found is None:  # a key without a geometry is related to nothing
                return self if negated else self._with(self.df.filter(F.lit(False)))
            key = bytes(found[0])
        from ..functions import kernel as k

        shape = k.from_wkb(key) if isinstance(key, (bytes, bytearray)) else k.box(*key)
        x0, x1, y0, y1 = k.envelope(shape)
        e = st.envelope(geom, kind)
        test = st.envelopes_meet(e, st.box_of(*(F.lit(v) for v in (x0 - dist, x1 + dist, y0 - dist, y1 + dist))))
        simple = not isinstance(key, (bytes, bytearray)) and kind in (st.POINT, st.ENVELOPE) and relation == "intersects"
        if not simple:
            test = test & st.relation(relation, dist)(st.wkb(geom, kind), F.lit(bytearray(k.to_wkb(shape))))
        test = F.coalesce(test, F.lit(False))
        return self._with(self.df.filter(~test if negated else test))

    # -- relational joins
    def hash_join(self, left_cols: str, right: "GeoFrame", right_cols: str, output: str, how: str = "inner") -> "GeoFrame":
        """Equi-join on zipped keys; ``output`` selects ``left.*`` and ``right.*`` columns (a semi join: left ones)."""
        if how not in JOIN_TYPES:
            raise ValueError(f"unknown join type {how!r}")
        lk, rk = _csv(left_cols), _csv(right_cols)
        if len(lk) != len(rk) or not lk:
            raise ValueError("the sides' keys differ in number")
        l, r = self.df.alias("left"), right.df.alias("right")
        on = [F.col(f"left.`{a}`") == F.col(f"right.`{b}`") for a, b in zip(lk, rk)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        picked = _select.parse(output, {"left": self.columns} if JOIN_TYPES[how] == "left_semi" else {"left": self.columns, "right": right.columns})
        out = l.join(r, cond, JOIN_TYPES[how]).select(*[F.col(f"{s.namespace}.`{s.column}`").alias(s.alias) for s in picked])
        return self._joined(out, picked, right)

    def _joined(self, out: DataFrame, picked: list, right: "GeoFrame") -> "GeoFrame":
        for side, frame in (("left", self), ("right", right)):
            for s in picked:
                if s.namespace == side and s.column == frame.geom:
                    return GeoFrame(out, s.alias, frame.srid)
        return GeoFrame(out)

    # -- spatial joins
    def _same_srid(self, right: "GeoFrame") -> None:
        if self.srid and right.srid and self.srid != right.srid:
            raise ValueError(f"reference systems differ: {self.srid} and {right.srid}")

    def _pairs(self, right: "GeoFrame", relation: str, dist: float, **options: Any) -> tuple[DataFrame, "GeoFrame"]:
        self._same_srid(right)
        self._geometry(), right._geometry()
        return _sjoin.pairs(self.df, self.geom, right.df, right.geom, relation, dist, **options), right

    def spatial_join(self, right: "GeoFrame | Any", output: str = "left.*", relation: str = "intersects", dist: float = 0.0, broadcast: bool | None = None) -> "GeoFrame":
        """A row for each related pair, once.

        A clustered data set as the right side is read in the tiles alone that the left side meets (which runs a job).
        """
        if not isinstance(right, GeoFrame):
            right = right.near(self, dist)
        found, _ = self._pairs(right, relation, dist, broadcast=broadcast)
        picked = _select.parse(output, {"left": self.columns, "right": right.columns})
        out = found.select(*[F.col(f"{s.namespace[0]}_row.`{s.column}`").alias(s.alias) for s in picked])
        return self._joined(out, picked, right)

    def _numbered(self) -> "GeoFrame":
        """Rows with a number that stays the same however often the plan runs: they are written first."""
        return GeoFrame(table(self.df.withColumn("__uid", F.monotonically_increasing_id())), self.geom, self.srid)

    def spatial_semi_join(self, right: "GeoFrame", relation: str = "intersects", negated: bool = False, dist: float = 0.0, key: str | None = None) -> "GeoFrame":
        """Left rows with a match, or without one if negated; null geometries have none.

        ``key`` names a unique column; without one the rows are numbered, which writes them.
        Points and envelopes that intersect make no pairs: their matched rows are written.
        """
        left = self if key else self._numbered()
        uid = key or "__uid"
        slim = GeoFrame(left.df.select(uid, left.geom), left.geom, left.srid)
        native = all(f._geometry()[1] in (st.POINT, st.ENVELOPE) for f in (slim, right))
        if native and relation == "intersects":
            self._same_srid(right)
            ids = table(_sjoin.matched(slim.df, uid, slim.geom, right.df, right.geom).withColumnRenamed(uid, "__m"))
        else:
            found, _ = slim._pairs(GeoFrame(right.df.select(right.geom).distinct(), right.geom, right.srid), relation, dist)
            ids = found.select(F.col(f"l_row.`{uid}`").alias("__m")).distinct()
        out = left.df.join(ids, left.df[uid] == ids["__m"], "left_anti" if negated else "left_semi")
        return self._with(out if key else out.drop("__uid"))

    def _against_matches(self, right: "GeoFrame", keep_unmatched: bool, f: Callable) -> "GeoFrame":
        """Each left geometry and the list of its matches through a kernel function; None drops the row."""
        from ..functions import kernel as k

        left = self._numbered()
        slim = GeoFrame(left.df.select("__uid", left.geom), left.geom, left.srid)
        found, _ = slim._pairs(GeoFrame(right.df.select(right.geom), right.geom, right.srid), "intersects", 0.0)
        other = st.wkb(F.col(f"r_row.`{right.geom}`"), right.schema[right.geom].dataType)
        each = found.select(F.col("l_row.__uid").alias("__u"), other.alias("g"))
        # a row with very many matches gets their unions by parts, so that no task gathers them all
        counts = each.groupBy("__u").agg(F.ceil(F.count(F.lit(1)) / MATCHES).alias("__parts"))
        dealt = each.join(counts, "__u").withColumn("__part", F.expr("pmod(xxhash64(g), __parts)"))
        parts = dealt.groupBy("__u", "__parts", "__part").agg(F.collect_list("g").alias("gs"))

        @F.pandas_udf(T.ArrayType(T.BinaryType()))
        def melted(v: pd.Series) -> pd.Series:
            return pd.Series([[k.to_wkb(st._union_of(st._read(gs)))] for gs in v])

        parts = parts.filter("__parts = 1").select("__u", "gs").union(parts.filter("__parts > 1").select("__u", melted("gs").alias("gs")))
        lists = parts.groupBy("__u").agg(F.flatten(F.collect_list("gs")).alias("__others"))
        both = left.df.join(lists, left.df["__uid"] == lists["__u"], "left" if keep_unmatched else "inner")

        @F.pandas_udf(T.BinaryType())
        def run(own: pd.Series, others: pd.Series) -> pd.Series:
            out = []
            for g, hs in zip(own, others):
                if g is None or hs is None or not len(hs):
                    out.append(g)
                    continue
                v = f(k.from_wkb(bytes(g)), st._read(hs))
                out.append(None if v is None or v.empty else k.to_wkb(v))
            return pd.Series(out, dtype=object)

        made = both.withColumn("__new", run(left._wkb(), F.col("__others")))
        was_null = F.col(f"`{self.geom}`").isNull()
        made = made.filter(F.col("__new").isNotNull() | (was_null if keep_unmatched else F.lit(False)))
        cols = [F.col("__new").alias(c) if c == self.geom else F.col(f"`{c}`") for c in self.columns]
        return self._with(made.select(*cols))

    def difference_join(self, right: "GeoFrame") -> "GeoFrame":
        """Left geometries without all that the right covers; emptied rows go, polygons and lines become Multi ones."""
        from ..functions import kernel as k

        return self._against_matches(right, True, lambda g, hs: k.multi(k.difference(g, k.union_all(hs))))

    def arc_clip(self, right: "GeoFrame") -> "GeoFrame":
        """Left geometries cut to the union of their common parts with all matches; rows without one go."""
        from ..functions import kernel as k

        return self._against_matches(right, False, lambda g, hs: k.union_all([k.intersection(g, h) for h in hs]))

    # -- grouping
    def aggregate(self, *aggs: Agg) -> "GeoFrame":
        """One row, always."""
        return self.aggregate_by_group(Group(), *aggs)

    def aggregate_by_group(self, group: Group | str, *aggs: Agg, tags: str | None = None) -> "GeoFrame":
        """Keys, tags (from any row of the group) and aggregates.

        Hulls and unions are made within each task, then of parts of the tasks' results
        and then of the parts', so a large group is not gathered in one piece.
        """
        g = Group.of(group, tags)
        slow = [a for a in aggs if a.kind in SPATIAL]
        df = self.df
        cols: list[Column] = [F.first(F.col(f"`{t}`"), ignorenulls=True).alias(t) for t in g.tags if t not in g.keys]
        for a in aggs:
            if a.kind == "envelope":
                e = st.envelope(F.col(f"`{a.column}`"), df.schema[a.column].dataType)
                parts = [F.min(e["xmin"]).alias("xmin"), F.max(e["xmax"]).alias("xmax"), F.min(e["ymin"]).alias("ymin"), F.max(e["ymax"]).alias("ymax")]
                whole = F.struct(*parts)
                cols.append(F.when(F.min(e["xmin"]).isNotNull(), whole).alias(a.output))
            elif a.kind not in SPATIAL:
                cols.append(a.native())
        keys = [F.col(f"`{k}`") for k in g.keys]
        out = df.groupBy(*keys).agg(*(cols or [F.count(F.lit(1)).alias("__n")]))
        for a in (s for s in slow if s.kind != "envelope"):
            ship(df.sparkSession)
            f = st.hull_agg if a.kind == "convex_hull" else st.union_agg
            w = st.wkb(F.col(f"`{a.column}`"), df.schema[a.column].dataType)
            rows = st.partials(df.select(*keys, w.alias("__g")).filter("__g is not null"), a.kind).withColumn("__s", F.xxhash64("__g") % 64)
            first = rows.groupBy(*g.keys, "__s").agg(f(F.col("__g")).alias("__g"))
            made = first.groupBy(*g.keys).agg(f(F.col("__g")).alias(a.output))
            if g.keys:
                named = made.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(g.keys)], F.col(f"`{a.output}`"))
                cond = F.lit(True)
                for i, k in enumerate(g.keys):
                    cond = cond & out[f"`{k}`"].eqNullSafe(F.col(f"__k{i}"))
                out = out.join(named, cond, "left").drop(*[f"__k{i}" for i in range(len(g.keys))])
            else:  # one row each
                out = out.withColumn("__j", F.lit(1)).join(made.withColumn("__j", F.lit(1)), "__j", "left").drop("__j")
        names = [*g.keys, *(t for t in g.tags if t not in g.keys), *(a.output for a in aggs)]
        geom = next((a.output for a in slow), None)
        return GeoFrame(out.select(*[F.col(f"`{n}`") for n in names]), geom, self.srid if geom else None)

    def take_by_group(self, group: Group | str, n: int, order: str | None = None) -> "GeoFrame":
        """The first n rows of each group, whole; any n without an order."""
        g = Group.of(group, None, order)
        w = Window.partitionBy(*g.keys).orderBy(*(g.order_columns() or [F.lit(1)]))
        return self._with(self.df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn"))

    def distinct(self, keys: str) -> "GeoFrame":
        return self._with(self.df.dropDuplicates(_csv(keys)))

    def pivot(self, group: str, pivot_col: str, agg: Agg, values: Sequence[Any] | None = None) -> "GeoFrame":
        """Sums by pivot value; without ``values`` Spark runs a job for them."""
        if agg.kind != "sum":
            raise ValueError("pivot sums only")
        return GeoFrame(self.df.groupBy(*_csv(group)).pivot(pivot_col, list(values) if values is not None else None).agg(F.sum(f"`{agg.column}`")))

    @staticmethod
    def union(frames: "Sequence[GeoFrame]") -> "GeoFrame":
        """All rows of one frame or more with the same columns and types."""
        if not frames:
            raise ValueError("nothing to unite")
        first = frames[0]
        shape = lambda f: [(x.name, x.dataType) for x in f.schema]
        df = first.df
        for f in frames[1:]:
            if shape(f) != shape(first):
                raise ValueError(f"schemas differ: {f.schema.simpleString()} and {first.schema.simpleString()}")
            df = df.unionByName(f.df)
        return first._with(df)

    # -- geometry
    def _mapped(self, value: Column, output: str | None, drop_null: bool = False) -> "GeoFrame":
        name = output or self.geom
        out = self.df.withColumn(name, value)
        return GeoFrame(out, name, self.srid)

    def buffer(self, dist: float | str, output: str | None = None, throw_op_error: bool = False) -> "GeoFrame":
        """All within a distance, or within a column's value.

        A geometry for which the operation fails becomes NULL, here and in the
        methods below, unless ``throw_op_error``.
        """
        if not isinstance(dist, str) and dist <= 0:
            raise ValueError("a buffer's distance is positive")
        d = F.col(f"`{dist}`").cast("double") if isinstance(dist, str) else F.lit(float(dist))
        return self._mapped(_strict(st._buffer, throw_op_error)(self._wkb(), d), output)

    def centroid(self, inside: bool = False, output: str | None = None, throw_op_error: bool = False) -> "GeoFrame":
        return self._mapped(_strict(st._interior if inside else st._centroid, throw_op_error)(self._wkb()), output)

    def to_point(self, x: str, y: str, output: str = "the_geom", srid: str | None = None) -> "GeoFrame":
        """A native point of two columns of numbers or numeric strings."""
        plain = all(isinstance(self.df.schema[c].dataType, (T.DoubleType, T.IntegralType)) for c in (x, y))
        return GeoFrame(self.df.withColumn(output, st.point_of(F.col(f"`{x}`"), F.col(f"`{y}`"), plain)), output, srid or self.srid)

    def to_box(self, xmin: str, ymin: str, xmax: str, ymax: str, output: str = "the_geom", srid: str | None = None) -> "GeoFrame":
        """A native envelope of four columns."""
        return GeoFrame(self.df.withColumn(output, st.box_of(*(F.col(f"`{c}`") for c in (xmin, xmax, ymin, ymax)))), output, srid or self.srid)

    def transform_crs(self, srid: str, transform: Callable | None = None, throw_op_error: bool = False) -> "GeoFrame":
        """Between EPSG:4326 and EPSG:3857, or by a function of coordinate arrays (x, y)."""
        if srid == self.srid:
            return self
        geom, kind = self._geometry()
        r = 6378137.0
        mercator = (self.srid, srid) == ("EPSG:4326", "EPSG:3857")
        degrees = (self.srid, srid) == ("EPSG:3857", "EPSG:4326")
        if not transform and not mercator and not degrees:
            raise ValueError(f"no transform from {self.srid} to {srid}")
        if kind == st.POINT and not transform:
            x, y = geom["x"], geom["y"]
            nx = F.radians(x) * r if mercator else F.degrees(x / r)
            ny = F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * r + 0.0 if mercator else F.degrees(F.atan(F.exp(y / r)) * 2 - math.pi / 2)
            value = F.when(geom.isNotNull(), F.struct(nx.alias("x"), ny.alias("y")))
        else:
            import numpy as np

            from ..functions import kernel as k

            def forward(x, y):
                return np.radians(x) * r, np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * r

            def back(x, y):
                return np.degrees(x / r), np.degrees(2 * np.arctan(np.exp(y / r)) - np.pi / 2)

            move = transform or (forward if mercator else back)

            def moved(g: k.Geom) -> k.Geom:
                if g.kind in ("Point", "LineString"):
                    return k.Geom(g.kind, np.column_stack(move(g.parts[:, 0], g.parts[:, 1])))
                if g.kind == "Polygon":
                    return k.Geom(g.kind, [np.column_stack(move(c[:, 0], c[:, 1])) for c in g.parts])
                return k.Geom(g.kind, [moved(m) for m in g.parts])

            def one(b):
                try:
                    return None if b is None else k.to_wkb(moved(k.from_wkb(bytes(b))))
                except Exception:
                    if throw_op_error:
                        raise
                    return None

            @F.pandas_udf(T.BinaryType())
            def run(v: pd.Series) -> pd.Series:
                return pd.Series([one(b) for b in v], dtype=object)

            value = run(self._wkb())
        return GeoFrame(self.df.withColumn(self.geom, value), self.geom, srid)

    def intersection(self, other: str, output: str | None = None, throw_op_error: bool = False) -> "GeoFrame":
        """Row by row with another geometry column; native for two envelopes."""
        geom, kind = self._geometry()
        right = self.df.schema[other].dataType
        o = F.col(f"`{other}`")
        if kind == st.ENVELOPE and right == st.ENVELOPE:
            common = st.box_of(F.greatest(geom["xmin"], o["xmin"]), F.least(geom["xmax"], o["xmax"]), F.greatest(geom["ymin"], o["ymin"]), F.least(geom["ymax"], o["ymax"]))
            return self._mapped(F.when(st.envelopes_meet(geom, o), common), output)
        return self._mapped(_strict(st._intersection, throw_op_error)(self._wkb(), st.wkb(o, right)), output)

    def assign_grid_cell(self, grid: _grid.SquareGrid, assign_outside: bool = False) -> "GeoFrame":
        self._geometry()
        return self._with(_grid.assign_cells(self.df, self.geom, grid, assign_outside))

    def arc_buffer(self, dist: float, dissolve: bool = False) -> "GeoFrame":
        """Buffers with a number ``FID``; dissolved: one union for each connected set, as (geometry, FID)."""
        numbered = self.assign_uid("FID")
        if not dissolve:
            return numbered.spread().buffer(dist)
        # equal geometries are buffered once, and equal buffers are one, of the smallest number
        rows = GeoFrame(table(numbered.df.select("FID", self.geom)), self.geom, self.srid)
        first = GeoFrame(rows.df.groupBy(self.geom).agg(F.min("FID").alias("FID")), self.geom, self.srid)
        first = table(GeoFrame(first.df.withColumn("__own", F.col(f"`{self.geom}`")), self.geom, self.srid).spread().buffer(dist).df)
        made = GeoFrame(first, self.geom, self.srid)
        solid = st.envelope(*made._geometry()).isNotNull()
        first = table(made.df.withColumn("__solid", solid))
        once = table(first.filter("__solid").groupBy(made.geom).agg(F.min("FID").alias("FID")).select("FID", made.geom))
        # null and empty ones meet nothing and stay as they are, each with its number
        void = first.filter("NOT __solid").select("__own", F.col(f"`{made.geom}`").alias("__made"))
        void = rows.df.join(void, F.col(f"`{made.geom}`").eqNullSafe(F.col("__own"))).select("FID", F.col("__made").alias(made.geom))
        label = components(_sjoin.links(once, "FID", made.geom))
        named = once.join(label, once.FID == label.v, "left").select(F.coalesce("c", "FID").alias("FID"), made.geom)
        named = spread(named.union(void))
        out = GeoFrame(named, made.geom, made.srid).aggregate_by_group("FID", Agg("union_geom", made.geom, made.geom))
        return GeoFrame(out.df.select(made.geom, "FID"), made.geom, made.srid)

    # -- quad keys
    def attach_quad_key(self, keys: list[str], valid: tuple | None = None, bind_outlier: bool = True, owner_only: bool = False) -> "GeoFrame":
        self._geometry()
        return self._with(_quad.attach(self.df, self.geom, keys, valid, bind_outlier, owner_only))

    def estimate_quad_keys(self, ratio: float = 1.0, valid: tuple | None = None, cluster_bytes: float = 64 << 20, row_bytes: Column | None = None) -> list[str]:
        self._geometry()
        return _quad.estimate(self.df, self.geom, ratio, valid, cluster_bytes, row_bytes)

    def partition_by_quad_key(self, keys: list[str] | None = None, ratio: float = 1.0, cluster_bytes: float = 64 << 20, bind_outlier: bool = True, count: int | None = None) -> "GeoFrame":
        keys = keys or self.estimate_quad_keys(ratio, None, cluster_bytes)
        return self._with(_quad.partition(self.attach_quad_key(keys, None, bind_outlier).df, keys, count or len(keys) + 1))

    def split_to_pair(self, keys: str) -> tuple[list[str], list[str]]:
        """Names of the key columns and of the others."""
        own = _csv(keys)
        return own, [c for c in self.columns if c not in own]

    def map_to_pair(self, keys: str) -> "GeoFrame":
        """``key`` (struct of the keys) and ``value`` (struct of the row)."""
        return GeoFrame(self.df.select(F.struct(*_csv(keys)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("value")))

    def keys(self, columns: str) -> "GeoFrame":
        return GeoFrame(self.df.select(*_csv(columns)))

    def partition_by_key(self, columns: str, count: int | None = None) -> "GeoFrame":
        cols = [F.col(c) for c in _csv(columns)]
        return self._with(self.df.repartition(count, *cols) if count else self.df.repartition(*cols))

    # -- actions and storage
    def collect(self) -> list:
        return self.df.collect()

    def to_local(self):
        return self.df.toLocalIterator()

    def take_first(self):
        return self.df.first()

    def count(self) -> int:
        return self.df.count()

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=60)

    def cache(self) -> "GeoFrame":
        return self._with(self.df.persist(StorageLevel.MEMORY_AND_DISK))

    def unpersist(self) -> "GeoFrame":
        return self._with(self.df.unpersist())

    def coalesce(self, n: int) -> "GeoFrame":
        return self._with(self.df.coalesce(n))

    def spread(self) -> "GeoFrame":
        """Rows dealt to many tasks, for what costs much a row."""
        return self._with(spread(self.df))

    def broadcast(self) -> "GeoFrame":
        """Marked for broadcast joins, if Catalyst's estimate of its size allows that."""
        return self._with(F.broadcast(self.df)) if _sjoin.estimated_bytes(self.df) <= _sjoin.FORCED_BYTES else self
