"""Spatial functions for columns and SQL.

A geometry column is one of: WKB in a binary column, a native point
``struct<x,y: double>``, or a native envelope ``struct<xmin,xmax,ymin,ymax: double>``.
Functions on native columns stay in the JVM; those on WKB run in Arrow-batched pandas
UDFs. :func:`register` adds the ST_* names to a session's SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as k

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
ENVELOPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "xmax", "ymin", "ymax")])


def _scalar(f: Callable, returns, null=None, geoms: int = 1, wkb_out: bool = False, many: Callable | None = None):
    """A pandas UDF of a kernel function whose first ``geoms`` arguments are WKB.

    A row that fails, as one whose WKB is broken, gives NULL; the UDF's ``strict`` twin
    raises. ``null`` is the value for null arguments. ``many`` makes the results of a
    whole batch from its flat coordinates, None where a row is to be worked on alone.
    """

    def build(strict: bool):
        @wraps(f)
        def run(*cols: pd.Series):
            out = []
            ready = many(k.Flat(cols[0])) if many else repeat(None)
            for row, got in zip(zip(*cols), ready):
                if got is not None:
                    out.append(got)
                    continue
                if any(v is None or (isinstance(v, float) and v != v) for v in row):
                    out.append(null)
                    continue
                try:
                    v = f(*[k.from_wkb(bytes(x)) for x in row[:geoms]], *row[geoms:])
                    out.append(k.to_wkb(v) if wkb_out and v is not None else v)
                except Exception:
                    if strict:
                        raise
                    out.append(None)
            if isinstance(returns, T.StructType):
                return pd.DataFrame([o if o is not None else (None,) * len(returns) for o in out], columns=returns.names)
            return pd.Series(out, dtype=object)

        if f.__code__.co_argcount == 1:
            def udf1(a: pd.Series) -> pd.Series:
                return run(a)
            chosen = udf1
        else:
            def udf2(a: pd.Series, b: pd.Series) -> pd.Series:
                return run(a, b)
            chosen = udf2
        if isinstance(returns, T.StructType):
            chosen.__annotations__["return"] = pd.DataFrame
        return F.pandas_udf(chosen, returns)

    made = build(False)
    made.strict = build(True)
    return made


def _keep_empty(f: Callable) -> Callable:
    def run(g, d):
        return g if g.empty else f(g, d)

    return run


def _where_plain(f: Callable[[k.Flat], np.ndarray]) -> Callable[[k.Flat], list]:
    """Numbers as a list, None where a value was not read, or has none."""

    def run(flat: k.Flat) -> list:
        v = f(flat)
        return np.where(flat.plain & ~np.isnan(v), v.astype(object), None).tolist()

    return run


def _many_envelopes(flat: k.Flat) -> list:
    e = flat.envelopes()
    return [tuple(x) if ok else None for x, ok in zip(e.tolist(), flat.plain & ~np.isnan(e[:, 0]))]


def _many_centroids(flat: k.Flat) -> list:
    c = flat.centroids()
    return [x if ok else None for x, ok in zip(k.point_values(c), flat.plain & ~np.isnan(c).any(1))]


_binary, _double, _bool, _string = T.BinaryType(), T.DoubleType(), T.BooleanType(), T.StringType()

_area = _scalar(k.area, _double, many=_where_plain(k.Flat.areas))
_length = _scalar(k.length, _double, null=-1.0, many=_where_plain(k.Flat.lengths))
_distance = _scalar(k.distance, _double, null=-1.0, geoms=2)
_intersects = _scalar(k.intersects, _bool, null=False, geoms=2)
_contains = _scalar(k.contains, _bool, null=False, geoms=2)
_buffer = _scalar(_keep_empty(k.buffer), _binary, wkb_out=True)
_centroid = _scalar(k.centroid, _binary, wkb_out=True, many=_many_centroids)
_interior = _scalar(k.interior_point, _binary, wkb_out=True)
_hull = _scalar(k.convex_hull, _binary, wkb_out=True)
_intersection = _scalar(k.intersection, _binary, geoms=2, wkb_out=True)
_difference = _scalar(k.difference, _binary, geoms=2, wkb_out=True)
_union = _scalar(lambda a, b: k.union_all([a, b]), _binary, geoms=2, wkb_out=True)
_from_text = _scalar(k.from_wkt, _binary, geoms=0, wkb_out=True)
_as_text = _scalar(k.to_wkt, _string)
_from_geojson = _scalar(k.from_geojson, _binary, geoms=0, wkb_out=True)
_as_geojson = _scalar(k.to_geojson, _string)
_envelope = _scalar(k.envelope, ENVELOPE, many=_many_envelopes)


@F.pandas_udf(_binary)
def _point(x: pd.Series, y: pd.Series) -> pd.Series:
    xy = np.column_stack([x.to_numpy(float), y.to_numpy(float)])
    return pd.Series([v if ok else None for v, ok in zip(k.point_values(xy), ~np.isnan(xy).any(1))], dtype=object)



@F.pandas_udf(_binary)
def _same(v: pd.Series) -> pd.Series:
    return v


@F.pandas_udf(_binary)
def _box_wkb(e: pd.DataFrame) -> pd.Series:
    bounds = e[["xmin", "ymin", "xmax", "ymax"]].to_numpy(float)
    return pd.Series([v if ok else None for v, ok in zip(k.box_values(bounds), ~np.isnan(bounds).any(1))], dtype=object)


def wkb(c: Column, kind: T.DataType) -> Column:
    """Any geometry column as WKB."""
    if kind == POINT:
        return _point(c["x"], c["y"])
    if kind == ENVELOPE:
        return _box_wkb(c)
    return c


def box_of(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """A native envelope; NULL if a bound is."""
    whole = F.struct(xmin.cast("double").alias("xmin"), xmax.cast("double").alias("xmax"), ymin.cast("double").alias("ymin"), ymax.cast("double").alias("ymax"))
    return F.when(xmin.isNotNull() & xmax.isNotNull() & ymin.isNotNull() & ymax.isNotNull(), whole)


def point_of(x: Column, y: Column, plain: bool = False) -> Column:
    """A native point of numbers or numeric strings; NULL if either is null or empty.

    ``plain`` numbers, doubles or integers, are not read as text, which filters that are pushed down would do many times a row.
    """
    x, y = (F.when(c.isNotNull(), c.cast("double")) if plain else F.nullif(c.cast("string"), F.lit("")).cast("double") for c in (x, y))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def envelope(c: Column, kind: T.DataType) -> Column:
    """The envelope of any geometry column; native for points and envelopes."""
    if kind == ENVELOPE:
        return c
    if kind == POINT:
        return F.when(c.isNotNull(), F.struct(c["x"].alias("xmin"), c["x"].alias("xmax"), c["y"].alias("ymin"), c["y"].alias("ymax")))
    e = _envelope(c)
    return F.when(e["xmin"].isNotNull(), e)


def envelopes_meet(a: Column, b: Column) -> Column:
    """Closed; false for nulls."""
    return F.coalesce((a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"]), F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    return _intersects(a, b)


def relation(name: str, dist: float = 0.0) -> Callable[[Column, Column], Column]:
    """The exact predicate of a relation on WKB columns; null never matches."""
    if name not in ("intersects", "contains", "within", "within_distance"):
        raise ValueError(f"unknown spatial relation {name}")

    @F.pandas_udf(_bool)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[bytes, k.Geom] = {}  # a batch repeats the geometries of joins

        def get(v):
            v = bytes(v)
            if v not in seen:
                seen[v] = k.from_wkb(v)
            return seen[v]

        def test(x, y) -> bool:
            try:
                return x is not None and y is not None and k.relate(name, get(x), get(y), dist)
            except Exception:  # a geometry that can't be read is related to nothing
                return False

        return pd.Series([test(x, y) for x, y in zip(a, b)], dtype=bool)

    return run


def distance(a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column:
    """The distance of two geometry columns, -1 for nulls; native for points and envelopes."""
    if ka in (POINT, ENVELOPE) and kb in (POINT, ENVELOPE):
        x, y = envelope(a, ka), envelope(b, kb)
        dx = F.greatest(x["xmin"] - y["xmax"], y["xmin"] - x["xmax"], F.lit(0.0))
        dy = F.greatest(x["ymin"] - y["ymax"], y["ymin"] - x["ymax"], F.lit(0.0))
        return F.when(a.isNull() | b.isNull(), F.lit(-1.0)).otherwise(F.sqrt(dx * dx + dy * dy))
    return _distance(wkb(a, ka), wkb(b, kb))


def array_avg(c: Column) -> Column:
    """The mean of an array; NULL if it is null or empty."""
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.try_divide(total, F.size(c))


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))


def starts_with(a: Column, b: Column) -> Column:
    return F.coalesce(F.startswith(a, b), F.lit(False))


#: Functions by their SQL names, for columns and row scripts.
BY_NAME: dict[str, Callable[..., Column]] = {
    "ST_StartsWith": starts_with, "ST_ArrayAvg": array_avg, "ST_ArrayAvgD": array_avg, "ST_ArrayAvgF": array_avg, "ST_ArraySum": array_sum,
    "ST_Area": _area, "ST_Length": _length, "ST_Distance": _distance, "ST_Point": lambda x, y: _point(x.cast("double"), y.cast("double")),
    "ST_Intersects": _intersects, "ST_Contains": _contains, "ST_EnvelopeIntersects": envelopes_meet, "ST_Buffer": lambda g, d: _buffer(g, d.cast("double")), "ST_Centroid": _centroid,
    "ST_InteriorPoint": _interior, "ST_ConvexHull": _hull, "ST_Intersection": _intersection, "ST_Difference": _difference, "ST_Union": _union,
    "ST_GeomFromText": _from_text, "ST_AsText": _as_text, "ST_GeomFromWKB": lambda b: b, "ST_AsBinary": lambda g: g,
    "ST_GeomFromGeoJSON": _from_geojson, "ST_AsGeoJSON": _as_geojson, "ST_AsEnvelope": _envelope,
}

_SQL_BODIES = {
    "ST_StartsWith": ("a STRING, b STRING", "BOOLEAN", "coalesce(startswith(a, b), false)"),
    "ST_ArrayAvg": ("a ARRAY<DOUBLE>", "DOUBLE", "try_divide(aggregate(a, 0D, (s, x) -> s + x), size(a))"),
    "ST_ArraySum": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(a, 0D, (s, x) -> s + x)"),
    "ST_ArrayAvgD": ("a ARRAY<DOUBLE>", "DOUBLE", "try_divide(aggregate(a, 0D, (s, x) -> s + x), size(a))"),
    "ST_ArrayAvgF": ("a ARRAY<FLOAT>", "DOUBLE", "try_divide(aggregate(a, 0D, (s, x) -> s + x), size(a))"),
    "ST_EnvelopeIntersects": (
        "a STRUCT<xmin: DOUBLE, xmax: DOUBLE, ymin: DOUBLE, ymax: DOUBLE>, b STRUCT<xmin: DOUBLE, xmax: DOUBLE, ymin: DOUBLE, ymax: DOUBLE>",
        "BOOLEAN", "coalesce(a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax, false)",
    ),
}


def _read(v: pd.Series) -> list:
    """The geometries of a column; nulls and what can't be read are left out."""
    out = []
    for x in v:
        try:
            if x is not None:
                out.append(k.from_wkb(bytes(x)))
        except Exception:
            continue
    return out


def _aggregate(f: Callable[[list], k.Geom | None]):
    @F.pandas_udf(_binary)
    def run(v: pd.Series) -> bytes:
        out = f(_read(v))
        return None if out is None else k.to_wkb(out)

    return run


def _hull_of(gs: list) -> k.Geom | None:
    return k.convex_hull(k.Geom("GeometryCollection", gs)) if gs else None


def _union_of(gs: list) -> k.Geom | None:
    if not gs:
        return None
    while len(gs) > 1:  # melt in batches
        gs = [k.union_all(gs[i : i + 64]) for i in range(0, len(gs), 64)]
    return k.multi(k.union_all(gs))


def _box_of(gs: list) -> k.Geom | None:
    boxes = [e for e in map(k.envelope, gs) if e]
    if not boxes:
        return None
    a, b, c, d = zip(*boxes)  # xmin, xmax, ymin, ymax
    return k.box(min(a), min(c), max(b), max(d))


hull_agg, union_agg, envelope_agg = map(_aggregate, (_hull_of, _union_of, _box_of))


@F.pandas_udf(_string)
def _concat_agg(v: pd.Series, delim: pd.Series) -> str:
    return (delim.iloc[0] or "").join(sorted(str(x) for x in v if x is not None)) if len(v) else ""


#: Geometries of a group that a task holds before it melts them, and groups' geometries that it holds in all.
MELT, HELD = 64, 20_000


def partials(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of keys and, last, WKB to fewer ones: each the hull or union of what one task has of a group.

    Tasks combine before anything is shuffled, so that the rows of a group are as few as tasks, whatever its size.
    """
    melt = _hull_of if kind == "convex_hull" else _union_of

    def run(batches):
        import pyarrow as pa

        held: dict[str, tuple[tuple, list]] = {}
        count, schema = 0, None

        def flush():
            cols = list(zip(*((*key, k.to_wkb(melt(gs))) for key, gs in held.values())))
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for *key, g in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    shape = k.from_wkb(g)
                except Exception:
                    continue
                own = held.setdefault(repr(key), (tuple(key), []))[1]
                own.append(shape)
                count += 1
                if len(own) >= MELT:
                    count -= len(own) - 1
                    own[:] = [melt(own)]
            if count > HELD:
                yield flush()
                held, count = {}, 0
        if held:
            yield flush()

    return rows.mapInArrow(run, rows.schema)


def register(spark: SparkSession) -> None:
    """Add the ST_* functions and geometry aggregates to the session's SQL.

    ``envelope(g)`` gives the box of a group as WKB, ``concat_str(s, delimiter)`` its
    strings in sorted order.
    """
    for name, (args, returns, body) in _SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    udfs = {"ST_Point": _point, "ST_Buffer": _buffer} | {n: f for n, f in BY_NAME.items() if hasattr(f, "returnType")}
    # Spark has built-in functions of these two names for a type of its own; a registered one goes first
    udfs |= {"ST_GeomFromWKB": _same, "ST_AsBinary": _same}
    udfs |= {"convex_hull": hull_agg, "union_geom": union_agg, "envelope": envelope_agg, "concat_str": _concat_agg}
    for name, f in udfs.items():
        spark.udf.register(name, f)
