"""Square grids: every cell that a geometry touches."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import st


@dataclass(frozen=True)
class SquareGrid:
    """Bounds (xmin, ymin, xmax, ymax), cell size and a margin around the bounds."""

    bounds: tuple[float, float, float, float]
    cell: tuple[float, float]
    margin: float = 0.0

    @staticmethod
    def parse(text: str, bounds_of=None) -> "SquareGrid":
        """``bounds=(x0,y0):(x1,y1);cell=WxH[;margin=m]`` or ``dataset=id;cell=WxH``; bounds_of gives a dataset's bounds."""
        parts = dict(p.strip().split("=", 1) for p in text.split(";") if p.strip())
        w, h = (float(v) for v in parts["cell"].lower().split("x"))
        if "dataset" in parts:
            bounds = bounds_of(parts["dataset"])
        else:
            bounds = tuple(float(v) for v in parts["bounds"].replace("(", "").replace(")", "").replace(":", ",").split(","))
        return SquareGrid(bounds, (w, h), float(parts.get("margin", 0)))

    @property
    def box(self) -> tuple[float, float, float, float]:
        x0, y0, x1, y1 = self.bounds
        return x0 - self.margin, y0 - self.margin, x1 + self.margin, y1 + self.margin

    @property
    def width(self) -> int:
        x0, _, x1, _ = self.box
        return math.ceil((x1 - x0) / self.cell[0])


def assign_cells(df: DataFrame, geom: str, grid: SquareGrid, outside: bool = False) -> DataFrame:
    """df with ``cell_geom`` (envelope), ``cell_pos`` (struct<x,y>) and ``cell_id`` = y * width + x, a row for each cell touched.

    Cells are those that meet the geometry, boundaries included; they are not
    clamped to the grid. A geometry that is null, empty or apart from the grid's
    bounds gives no row, or one with null cells if ``outside``. A geometry on a
    cell's lower edge also touches the cell below it.
    """
    kind = df.schema[geom].dataType
    x0, y0, x1, y1 = grid.box
    w, h = grid.cell
    env = df.withColumn("__e", st.envelope(F.col(f"`{geom}`"), kind))
    e = F.col("__e")
    whole = st.box_of(*(F.lit(float(v)) for v in (x0, x1, y0, y1)))
    meets = st.envelopes_meet(e, whole)
    first = lambda lo, o, s: F.ceil((lo - o) / s).cast("int") - 1
    last = lambda hi, o, s: F.floor((hi - o) / s).cast("int")
    xs = F.sequence(first(e["xmin"], x0, w), last(e["xmax"], x0, w))
    ys = F.sequence(first(e["ymin"], y0, h), last(e["ymax"], y0, h))
    wide = env.withColumn("__x", F.when(meets, xs)).withColumn("__y", F.when(meets, ys))
    cells = wide.withColumn("__x", F.explode_outer("__x")).withColumn("__y", F.explode_outer("__y"))
    cx, cy = F.col("__x"), F.col("__y")
    corner = lambda c, o, s: F.lit(o) + c * F.lit(s)
    cell = F.when(cx.isNotNull(), st.box_of(corner(cx, x0, w), corner(cx + 1, x0, w), corner(cy, y0, h), corner(cy + 1, y0, h)))
    out = cells.withColumns({"cell_geom": cell, "cell_pos": F.when(cx.isNotNull(), F.struct(cx.alias("x"), cy.alias("y"))), "cell_id": (cy.cast("long") * grid.width + cx).cast("long")})
    out = out.drop("__e", "__x", "__y")
    if kind not in (st.POINT, st.ENVELOPE):
        out = out.filter(F.col("cell_geom").isNull() | st.intersects(F.col(f"`{geom}`"), st.wkb(F.col("cell_geom"), st.ENVELOPE)))
    return out if outside else out.filter(F.col("cell_id").isNotNull())


def shared_area(a: Column, b: Column, kind_a: T.DataType = st.ENVELOPE, kind_b: T.DataType = st.ENVELOPE) -> Column:
    """The area that two geometries share; native for envelopes."""
    if kind_a == st.ENVELOPE and kind_b == st.ENVELOPE:
        w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
        h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return st.BY_NAME["ST_Area"](st.BY_NAME["ST_Intersection"](st.wkb(a, kind_a), st.wkb(b, kind_b)))
