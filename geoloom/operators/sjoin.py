"""Spatial joins as equi-joins on grid cells.

Catalyst plans an overlap condition as a nested loop. Here each side's envelopes are
put into the cells that they cover, the sides are hash-joined on the cell, and the
envelope test and the exact relation follow. A pair that shares several cells is
kept in one only, that of the lower left corner of the envelopes' common part, so no
``distinct`` is needed. Cells have levels, each 8 times as wide as the one before: an
envelope has the finest level at which it covers few cells, also lies in the coarser
ones, and two envelopes meet at the coarser of their levels. So no row covers many
cells, however unlike the extents are. A small right side is broadcast, by a check of its
size; else, where much is to be compared, crowded cells are divided by their rows, or AQE divides them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernel, st
from ..runtime import spread, table, tasks

#: Cells that one envelope may cover; larger ones join by coarser levels.
MAX_CELLS = 64
#: Levels of cells, each 8 times as wide as the one before.
LEVELS = 6
#: Right sides whose rows, once for each cell, have up to so many bytes are broadcast; the second where that is asked for.
BROADCAST_BYTES, FORCED_BYTES = 32 << 20, 256 << 20
#: Pairs of rows with a common cell from which a join's rows are dealt to tasks by that work, as their bytes don't tell it.
MUCH_WORK = 20_000_000
#: Pairs that a task of such a join compares about; the tasks grow with the work, up to the second number.
TASK_WORK, MAX_TASKS = 100_000_000, 10_000
#: What a row of a cell costs, in pairs of rows that are compared.
ROW_COST = 20
#: Rows from which a side whose rows cost little each is dealt to many tasks.
SPREAD_ROWS = 1_000_000


def _prepared(df: DataFrame, geom: str, side: str, grow: float = 0.0) -> DataFrame:
    e = st.envelope(F.col(f"`{geom}`"), df.schema[geom].dataType)
    cols = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"{side}_row"), e.alias("e"))
    cols = cols.filter(F.col("e").isNotNull())
    # a little more than ``grow``, as sums are rounded; the exact test decides
    more = lambda n: F.lit(grow) + (F.abs(F.col(f"e.{n}")) + grow) * 1e-12 if grow else F.lit(0.0)
    return cols.select(f"{side}_row", *[(F.col(f"e.{n}") + more(n) if n.endswith("max") else F.col(f"e.{n}") - more(n)).alias(f"{side}_{n}") for n in ("xmin", "xmax", "ymin", "ymax")])


@dataclass(frozen=True)
class Profile:
    """Rows of a side, the mean extents of their envelopes, and the bounds of all."""

    n: int
    w: float
    h: float
    bounds: tuple[float, float, float, float]

    def cells(self, size: float) -> float:
        return self.n * (self.w / size + 1) * (self.h / size + 1)


def profile(rows: DataFrame, side: str) -> Profile:
    """Of prepared rows. One job."""
    x0, x1, y0, y1 = (F.col(f"{side}_{n}") for n in ("xmin", "xmax", "ymin", "ymax"))
    r = rows.agg(F.count(F.lit(1)), F.avg(x1 - x0), F.avg(y1 - y0), F.min(x0), F.max(x1), F.min(y0), F.max(y1)).first()
    return Profile(r[0], r[1] or 0.0, r[2] or 0.0, tuple(r[3:])) if r[0] else Profile(0, 0.0, 0.0, (0.0, 0.0, 0.0, 0.0))


def compared(l: Profile, r: Profile, size: float) -> float:
    """About how many pairs of rows have a common cell."""
    spans = [max(min(l.bounds[k + 1], r.bounds[k + 1]) - max(l.bounds[k], r.bounds[k]), size) for k in (0, 2)]
    return l.cells(size) * r.cells(size) * size * size / (spans[0] * spans[1])


def chosen_size(l: Profile, r: Profile) -> float:
    """Of twice to a quarter of the mean extent, the cell size with the least to do; 1 for points alone."""
    mean = max((l.w + l.h) / 2, (r.w + r.h) / 2)
    if not mean:
        return 1.0
    return min((2 * mean / 2**k for k in range(4)), key=lambda s: compared(l, r, s) + ROW_COST * (l.cells(s) + r.cells(s)))


def cell_size(df: DataFrame, geom: str) -> float:
    """Twice the mean extent of a side's envelopes; 1 for points alone."""
    e = st.envelope(F.col(f"`{geom}`"), df.schema[geom].dataType)
    r = df.select(e.alias("e")).agg(F.avg((F.col("e.xmax") - F.col("e.xmin") + F.col("e.ymax") - F.col("e.ymin")) / 2)).first()[0]
    return 2 * r if r else 1.0


def _level(side: str, size: float) -> Column:
    """The finest level at which the envelope covers few cells."""
    extent = F.greatest(F.col(f"{side}_xmax") - F.col(f"{side}_xmin"), F.col(f"{side}_ymax") - F.col(f"{side}_ymin"))
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(extent <= size * 8**k * (MAX_CELLS**0.5 - 2), F.lit(k)).otherwise(level)
    return level


def _cells(df: DataFrame, side: str, size: float, top: int) -> DataFrame:
    """A row for each cell, from the envelope's own level to the top one."""
    out = df.withColumn("level", F.explode(F.sequence(F.col(f"{side}_level"), F.lit(top))))
    wide = F.lit(size) * F.pow(F.lit(8.0), F.col("level"))
    span = lambda a: F.sequence(F.floor(F.col(f"{side}_{a}min") / wide), F.floor(F.col(f"{side}_{a}max") / wide))
    return out.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_bytes(df: DataFrame, within: str = "") -> Column:
    """About how many bytes a row has in memory; the columns stand in the struct ``within``, if given."""
    at = f"{within}." if within else ""
    long = [F.coalesce(F.octet_length(F.col(f"{at}`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum(long, F.lit(64 + 16 * len(df.columns))).cast("double")


def _measured(prepared: DataFrame, df: DataFrame, side: str, size: float) -> dict[int, float]:
    """A side's levels, and about how many bytes the rows of each have, once for each cell of that level. One job."""
    wide = F.lit(size) * F.pow(F.lit(8.0), F.col(f"{side}_level"))
    span = lambda a: F.floor(F.col(f"{side}_{a}max") / wide) - F.floor(F.col(f"{side}_{a}min") / wide) + 1
    cells = span("x") * span("y")  # no coarser level has more
    return {r[0]: r[1] for r in prepared.groupBy(f"{side}_level").agg(F.sum(cells * row_bytes(df, f"{side}_row"))).collect()}


def _dealt(l_cells: DataFrame, r_cells: DataFrame, n: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt to n tasks by cell, and a crowded cell's left rows to several. Runs a job for the cells' rows."""
    keys, spark = ["level", "cx", "cy"], l_cells.sparkSession
    counts = l_cells.groupBy(*keys).count()
    total = l_cells.count() or 1
    crowded = [(r.level, r.cx, r.cy, -(-r["count"] * n // total)) for r in counts.filter(F.col("count") > total / n).collect()]  # at most n
    split = F.broadcast(spark.createDataFrame(crowded, "level int, cx long, cy long, parts long"))
    l_cells = l_cells.join(split, keys, "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))).drop("parts")
    r_cells = r_cells.join(split, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    keys = [*keys, "part"]
    return l_cells.repartition(n, *keys), r_cells.repartition(n, *keys), keys


def pairs(left: DataFrame, lgeom: str, right: DataFrame, rgeom: str, relation: str = "intersects", dist: float = 0.0, size: float | None = None, broadcast: bool | None = None) -> DataFrame:
    """(l_row, r_row): each pair of rows that are related, once; null and empty geometries match nothing.

    Runs jobs for extents, levels and sizes. Where much is to be compared, the rows are dealt to tasks by that.
    """
    kinds = {"l": left.schema[lgeom].dataType, "r": right.schema[rgeom].dataType}
    grow = dist if relation == "within_distance" else 0.0
    grown = "r" if kinds["l"] == st.POINT and kinds["r"] != st.POINT else "l"  # a point stays in one cell
    rows = {"l": _prepared(left, lgeom, "l", grow if grown == "l" else 0.0), "r": _prepared(right, rgeom, "r", grow if grown == "r" else 0.0)}
    if relation in ("contains", "within") and all(k in (st.POINT, st.ENVELOPE) for k in kinds.values()):
        held = "r" if relation == "contains" else "l"  # its corner alone has to be met
        rows[held] = rows[held].withColumns({f"{held}_xmax": F.col(f"{held}_xmin"), f"{held}_ymax": F.col(f"{held}_ymin")})
    found = {k: profile(r, k) for k, r in rows.items()}
    size = size or chosen_size(found["l"], found["r"])
    work = compared(found["l"], found["r"], size)
    much, n = work > MUCH_WORK, max(tasks(left.sparkSession), min(MAX_TASKS, int(work / TASK_WORK)))
    if much:
        rows["l"] = spread(rows["l"], n)
    rows = {k: r.withColumn(f"{k}_level", _level(k, size)) for k, r in rows.items()}
    held = _measured(rows["r"], right, "r", size)
    left_top = 0 if found["l"].w == found["l"].h == 0 else rows["l"].agg(F.max("l_level")).first()[0] or 0
    top = max(left_top, *held, 0)
    right_bytes = sum(v * (top - k + 1) for k, v in held.items())
    l_cells, r_cells = (_cells(r, k, size, top) for k, r in rows.items())
    on = ["level", "cx", "cy"]
    if broadcast is not False and right_bytes <= (FORCED_BYTES if broadcast else BROADCAST_BYTES):
        r_cells = F.broadcast(r_cells)
    elif much:
        l_cells, r_cells, on = _dealt(l_cells, r_cells, n)
    s = F.lit(size) * F.pow(F.lit(8.0), F.col("level"))
    meet = (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax")) & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
    once = (F.floor(F.greatest("l_xmin", "r_xmin") / s) == F.col("cx")) & (F.floor(F.greatest("l_ymin", "r_ymin") / s) == F.col("cy"))
    both = l_cells.join(r_cells, on).filter((F.col("level") == F.greatest("l_level", "r_level")) & meet & once)
    exact = _exact(relation, dist, F.col(f"l_row.`{lgeom}`"), left.schema[lgeom].dataType, F.col(f"r_row.`{rgeom}`"), right.schema[rgeom].dataType)
    return (both if exact is None else both.filter(exact)).select("l_row", "r_row")


def _covering(cells: DataFrame, size: float) -> DataFrame:
    """For each cell (level, cx, cy), few boxes that cover of it what all of the rows' envelopes do together.

    A box over a whole cell stands for all others there; else boxes are cut to the cell, and those that agree in all
    sides but one are one.
    """
    keys, sides = ["level", "cx", "cy"], ["r_xmin", "r_xmax", "r_ymin", "r_ymax"]
    s = F.lit(size) * F.pow(F.lit(8.0), F.col("level"))
    cut = {}
    for axis, c in (("x", F.col("cx")), ("y", F.col("cy"))):
        slack = F.lit(1e-6) + F.abs(c) * 1e-12  # a place that lies in a cell by rounding alone is within
        cut[f"r_{axis}min"] = F.greatest(F.col(f"r_{axis}min"), (c - slack) * s)
        cut[f"r_{axis}max"] = F.least(F.col(f"r_{axis}max"), (c + 1 + slack) * s)
        cut[f"whole_{axis}"] = (F.col(f"r_{axis}min") <= (c - slack) * s) & (F.col(f"r_{axis}max") >= (c + 1 + slack) * s)
    boxes = cells.withColumns(cut).groupBy(*keys, *sides).agg(F.max(F.col("whole_x") & F.col("whole_y")).alias("whole"))
    boxes = table(boxes)
    whole = boxes.filter("whole").select(*keys, *sides)
    part = boxes.filter("NOT whole").join(whole.select(*keys), keys, "left_anti").select(*keys, *sides)
    for side in sides:
        farthest = F.max(side) if side.endswith("max") else F.min(side)
        part = part.groupBy(*keys, *[x for x in sides if x != side]).agg(farthest.alias(side)).select(*keys, *sides)
    return table(whole.union(part))


def matched(left: DataFrame, uid: str, lgeom: str, right: DataFrame, rgeom: str) -> DataFrame:
    """The ids of left rows that meet any right one; both geometries are native.

    No pairs are made: a row ends at its first match, and the right side is few boxes a cell. Runs jobs.
    """
    rows = {"l": _prepared(left.select(uid, lgeom), lgeom, "l"), "r": _prepared(right.select(rgeom).distinct(), rgeom, "r")}
    found = {k: profile(r, k) for k, r in rows.items()}
    size = (found["r"].w + found["r"].h) / 8 or (found["l"].w + found["l"].h) / 2 or 1.0
    rows = {k: r.withColumn(f"{k}_level", _level(k, size)) for k, r in rows.items()}
    tops = {k: 0 if found[k].w == found[k].h == 0 else r.agg(F.max(f"{k}_level")).first()[0] or 0 for k, r in rows.items()}
    r_cells = _covering(_cells(rows["r"].drop("r_row"), "r", size, max(tops.values())), size)
    l_cells = _cells(spread(rows["l"]) if found["l"].n > SPREAD_ROWS else rows["l"], "l", size, max(tops.values()))
    if r_cells.count() * 128 <= BROADCAST_BYTES:
        r_cells = F.broadcast(r_cells)
    l, r = l_cells.alias("a"), r_cells.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("level", "cx", "cy")]
    meet = (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax")) & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
    return l.join(r, same[0] & same[1] & same[2] & meet, "left_semi").select(F.col(f"l_row.`{uid}`").alias(uid)).distinct()


def _exact(relation: str, dist: float, a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column | None:
    """The test beyond meeting envelopes; None where that decides."""
    native = {repr(st.POINT), repr(st.ENVELOPE)}
    if {repr(ka), repr(kb)} <= native:
        x, y = st.envelope(a, ka), st.envelope(b, kb)
        if relation == "intersects":
            return None
        if relation in ("contains", "within"):
            o, i, ki = (x, y, kb) if relation == "contains" else (y, x, ka)
            within = (o["xmin"] <= i["xmin"]) & (i["xmax"] <= o["xmax"]) & (o["ymin"] <= i["ymin"]) & (i["ymax"] <= o["ymax"])
            if ki == st.POINT:  # not on the boundary alone
                within = within & (o["xmin"] < i["xmin"]) & (i["xmin"] < o["xmax"]) & (o["ymin"] < i["ymin"]) & (i["ymin"] < o["ymax"])
            return within
        if relation == "within_distance":
            dx = F.greatest(x["xmin"] - y["xmax"], y["xmin"] - x["xmax"], F.lit(0.0))
            dy = F.greatest(x["ymin"] - y["ymax"], y["ymin"] - x["ymax"], F.lit(0.0))
            return F.sqrt(dx * dx + dy * dy) <= dist
    return st.relation(relation, dist)(st.wkb(a, ka), st.wkb(b, kb))


def forest(shapes: list, boxes: np.ndarray, own: np.ndarray, test: Callable) -> list[tuple[int, int]]:
    """Pairs of positions that connect what the test relates, without those between rows that are connected already.

    ``boxes`` has xmin, xmax, ymin, ymax; pairs of two rows that are not ``own`` are left out.
    """
    x0, x1, y0, y1 = boxes
    label, out = np.arange(len(shapes)), []
    for i in range(1, len(shapes)):
        near = np.flatnonzero((x0[:i] <= x1[i]) & (x0[i] <= x1[:i]) & (y0[:i] <= y1[i]) & (y0[i] <= y1[:i]))
        if not own[i]:
            near = near[own[near]]
        while len(near := near[label[near] != label[i]]):
            j, near = near[0], near[1:]
            if test(shapes[i], shapes[j]):
                out.append((i, int(j)))
                label[: i + 1][label[: i + 1] == label[i]] = label[j]
    return out


def links(df: DataFrame, id: str, geom: str) -> DataFrame:
    """(a, b): links between ids of WKB geometries that connect all that meet, at most one for each row of a cell.

    A cell's rows are united as they are compared, so a crowded cell costs no exact test for rows that others connect.
    Runs jobs for the cells' size and levels.
    """
    size = cell_size(df, geom) / 2
    rows = table(_prepared(df.select(id, geom), geom, "l").withColumn("l_level", _level("l", size)))
    top = rows.agg(F.max("l_level")).first()[0] or 0
    cells = _cells(rows, "l", size, top).select("level", "cx", "cy", F.col(f"l_row.`{id}`").alias("id"), F.col(f"l_row.`{geom}`").alias("g"), "l_xmin", "l_xmax", "l_ymin", "l_ymax", (F.col("l_level") == F.col("level")).alias("own"))

    def run(cell: pa.Table) -> pa.Table:
        ids, values, own = cell["id"].to_numpy(), cell["g"].to_pylist(), cell["own"].to_numpy()
        boxes = np.array([cell[f"l_{n}"].to_numpy() for n in ("xmin", "xmax", "ymin", "ymax")])
        read: dict[int, kernel.Geom] = {}

        def get(i: int) -> kernel.Geom:
            if i not in read:
                read[i] = kernel.from_wkb(values[i])
            return read[i]

        def test(i: int, j: int) -> bool:
            try:
                return kernel.intersects(get(i), get(j))
            except Exception:  # as in relations, a geometry that can't be read meets nothing
                return False

        got = forest(range(len(ids)), boxes, own, test) if own.any() else []
        return pa.table({k: pa.array(ids[[p[n] for p in got]] if got else [], pa.int64()) for n, k in enumerate("ab")})

    spark = df.sparkSession
    return cells.repartition(tasks(spark), "level", "cx", "cy").groupBy("level", "cx", "cy").applyInArrow(run, "a long, b long")
