"""Quad keys of web-mercator tiles: attach, estimate, partition."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import st
from ..runtime import ship

MAX_LAT = 85.0
OUTLIER = "outlier"
#: Keys up to which each row is held against all of them natively; more are looked up by their tiles.
FEW_KEYS = 64
#: Tiles of one level that an envelope's keys are looked up by; a wider one is held against the level's keys.
WIDE = 64


def tile(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    """The tile of a WGS84 place, clamped to the square."""
    n = 1 << zoom
    s = math.sin(math.radians(min(max(lat, -85.05112878), 85.05112878)))
    x, y = (lon + 180) / 360 * n, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * n
    return min(max(int(x), 0), n - 1), min(max(int(y), 0), n - 1)


def key_of(x: int, y: int, zoom: int) -> str:
    return "".join(str((x >> b & 1) | (y >> b & 1) << 1) for b in range(zoom - 1, -1, -1))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    s = F.sin(F.radians(F.least(F.greatest(lat, F.lit(-85.05112878)), F.lit(85.05112878))))
    return F.least(F.greatest(F.floor((0.5 - F.log((1.0 + s) / (1.0 - s)) / (4 * math.pi)) * n), F.lit(0)), F.lit(n - 1)).cast("long")


def quad_key(x: Column, y: Column, zoom: int) -> Column:
    """The key of a tile, a digit a level, from the top."""
    digits = [(F.shiftright(x, b).bitwiseAND(1) + F.shiftright(y, b).bitwiseAND(1) * 2).cast("string") for b in range(zoom - 1, -1, -1)]
    return F.concat(*digits) if digits else F.lit("")


def bounds(key: str) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax) of a key's tile in degrees."""
    x = sum((int(c) & 1) << b for b, c in zip(range(len(key) - 1, -1, -1), key))
    y = sum((int(c) >> 1) << b for b, c in zip(range(len(key) - 1, -1, -1), key))
    n = 1 << len(key)
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def lookup(keys: list[str]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function of envelopes (xmin, xmax, ymin, ymax by rows) to the rows and positions of the sorted keys that they meet, in order.

    A row's cost grows with its tiles and the keys' levels, not with the keys.
    """
    boxes = np.array([bounds(k) for k in keys]).reshape(-1, 4)
    levels = []
    for zoom in sorted({len(k) for k in keys}):
        at = np.array([i for i, k in enumerate(keys) if len(k) == zoom])
        n = 1 << zoom
        x = np.array([sum((int(c) & 1) << b for b, c in zip(range(zoom - 1, -1, -1), keys[i])) for i in at], np.int64)
        y = np.array([sum((int(c) >> 1) << b for b, c in zip(range(zoom - 1, -1, -1), keys[i])) for i in at], np.int64)
        order = np.argsort(x * n + y, kind="stable")
        levels.append((n, (x * n + y)[order], at[order]))

    def find(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        meet = lambda r, k: (boxes[k, 0] <= e[r, 1]) & (e[r, 0] <= boxes[k, 2]) & (boxes[k, 1] <= e[r, 3]) & (e[r, 2] <= boxes[k, 3])
        sane = np.flatnonzero(np.isfinite(e).all(1) & (e[:, 0] <= e[:, 1]) & (e[:, 2] <= e[:, 3]))
        odd = np.setdiff1d(np.arange(len(e)), sane)
        sines = np.sin(np.radians(np.clip(e[sane, 2:], -85.05112878, 85.05112878)))
        down = 0.5 - np.log((1 + sines) / (1 - sines)) / (4 * math.pi)
        across = (e[sane, :2] + 180) / 360
        found = []
        for n, codes, at in levels:
            # a little more than the envelope, as edges count and are rounded; the boxes decide
            lo_x, hi_x = (np.clip(np.floor(across[:, c] * n + d), 0, n - 1).astype(np.int64) for c, d in ((0, -1e-6), (1, 1e-6)))
            lo_y, hi_y = (np.clip(np.floor(down[:, c] * n + d), 0, n - 1).astype(np.int64) for c, d in ((1, -1e-6), (0, 1e-6)))
            high = hi_y - lo_y + 1
            tiles = (hi_x - lo_x + 1) * high
            small = np.flatnonzero(tiles <= WIDE)
            r = np.repeat(small, tiles[small])
            nth = np.arange(len(r)) - np.repeat(np.cumsum(tiles[small]) - tiles[small], tiles[small])
            code = (lo_x[r] + nth // high[r]) * n + lo_y[r] + nth % high[r]
            first, last = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
            for again in range(int((last - first).max(initial=0))):  # a key may be given twice
                hit = first + again < last
                found.append((sane[r[hit]], at[first[hit] + again]))
            for i in np.concatenate([sane[tiles > WIDE], odd]):
                found.append((np.full(len(at), i), at))
        rows, at = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in (0, 1))
        ok = meet(rows, at)
        rows, at = rows[ok], at[ok]
        order = np.lexsort((at, rows))
        return rows[order], at[order]

    return find


def _held_against(keys: list[str], m: Column) -> Column:
    rows = [(k, *bounds(k)) for k in keys]
    boxes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d")) for k, a, b, c, d in rows])
    hit = F.filter(boxes, lambda t: (t["a"] <= m["xmax"]) & (m["xmin"] <= t["c"]) & (t["b"] <= m["ymax"]) & (m["ymin"] <= t["d"]))
    return F.transform(hit, lambda t: t["k"])


def _names(keys: list[str], m: Column) -> Column:
    """The sorted keys whose tiles an envelope meets; NULL for no envelope."""
    find = lookup(keys)

    @F.arrow_udf("array<string>")
    def run(xmin: pa.Array, xmax: pa.Array, ymin: pa.Array, ymax: pa.Array) -> pa.Array:
        e = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (xmin, xmax, ymin, ymax)])
        there = np.flatnonzero(xmin.is_valid().to_numpy(zero_copy_only=False))
        rows, at = find(e[there])
        ends = np.concatenate([[0], np.cumsum(np.bincount(there[rows], minlength=len(e)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys, pa.string()).take(pa.array(at)))

    return run(*(m[n] for n in ("xmin", "xmax", "ymin", "ymax")))


def attach(df: DataFrame, geom: str, keys: list[str], valid: tuple[float, float, float, float] | None = None, bind_outlier: bool = True, owner_only: bool = False, tiles: str | None = None) -> DataFrame:
    """df with ``quad_key`` and ``mbr``: a row for each key's tile that the geometry's envelope meets.

    With ``owner_only`` just the first such key in order; ``tiles`` names a column for
    all of the row's keys. Rows that meet no key (or
    lie beyond ``valid``, or have no geometry) get the key ``outlier``, or go. A few
    keys are a literal that is matched in the row; more are looked up by their tiles.
    """
    e = st.envelope(F.col(f"`{geom}`"), df.schema[geom].dataType)
    out = df.withColumn("mbr", e)
    m = F.col("mbr")
    inside = m.isNotNull()
    if valid:
        inside &= st.envelopes_meet(m, st.box_of(F.lit(float(valid[0])), F.lit(float(valid[2])), F.lit(float(valid[1])), F.lit(float(valid[3]))))
    if len(keys) > FEW_KEYS:
        ship(df.sparkSession)
        names = _names(sorted(keys), m)
    else:
        names = _held_against(sorted(keys), m)
    if owner_only:
        names = F.slice(names, 1, 1)
    names = F.when(inside, names)
    names = F.when(names.isNull() | (F.size(names) == 0), F.array(F.lit(OUTLIER)) if bind_outlier else F.array().cast("array<string>")).otherwise(names)
    if tiles:
        out, names = out.withColumn(tiles, names), F.col(tiles)
    return out.withColumn("quad_key", F.explode(names))


def estimate(df: DataFrame, geom: str, ratio: float = 1.0, valid: tuple[float, float, float, float] | None = None, cluster_bytes: float = 64 << 20, row_bytes: Column | None = None, max_zoom: int = 16, seed: int = 7) -> list[str]:
    """Leaf keys whose tiles hold up to ``cluster_bytes`` each.

    Rows are summed by deep tile on the executors, level by level from the top, and
    only tiles that are too full are divided, so what comes to the driver is the
    tree's own nodes. The tiles to divide go out as a table, not as a list in the plan.
    """
    rows = df.sample(False, ratio, seed) if ratio < 1 else df
    e = st.envelope(F.col(f"`{geom}`"), df.schema[geom].dataType)
    size = row_bytes if row_bytes is not None else F.lit(128)
    rows = rows.select(e.alias("e"), size.cast("double").alias("s")).filter(F.col("e").isNotNull())
    lon, lat = (F.col("e.xmin") + F.col("e.xmax")) / 2, (F.col("e.ymin") + F.col("e.ymax")) / 2
    rows = rows.filter(lat.between(-MAX_LAT, MAX_LAT) & lon.between(-180, 180))
    if valid:
        rows = rows.filter(st.envelopes_meet(F.col("e"), st.box_of(F.lit(float(valid[0])), F.lit(float(valid[2])), F.lit(float(valid[1])), F.lit(float(valid[3])))))
    deep = rows.select(quad_key(tile_x(lon, max_zoom), tile_y(lat, max_zoom), max_zoom).alias("k"), "s").groupBy("k").agg(F.sum("s").alias("s")).cache()
    limit, leaves, full, depth = cluster_bytes * min(ratio, 1.0), [], [""], 0
    spark = df.sparkSession
    while full:
        held = deep
        if depth:
            divided = spark.createDataFrame([(k,) for k in full], "f string")
            held = deep.join(F.broadcast(divided), F.substring("k", 1, depth - 1) == F.col("f"), "left_semi")
        sums = {r.p: r.s for r in held.groupBy(F.substring("k", 1, depth).alias("p")).agg(F.sum("s").alias("s")).collect()}
        full = [k for k, s in sums.items() if s > limit and depth < max_zoom]
        leaves += set(sums) - set(full)
        depth += 1
    deep.unpersist()
    return sorted(leaves)


def partition(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows dealt by ``quad_key`` in the keys' order: neighbours lie in the same partition or the next, outliers in the last."""
    order = sorted(k for k in keys if k != OUTLIER)
    last = max(1, count - 1)
    place = {k: min(last - 1, i * last // max(1, len(order))) for i, k in enumerate(order)}
    if count < 2 or not place:
        return df.repartition(1)
    places = df.sparkSession.createDataFrame(list(place.items()), "__key string, __place int")
    at = df.join(F.broadcast(places), F.col("quad_key") == F.col("__key"), "left").drop("__key")
    return at.repartitionById(count, F.coalesce("__place", F.lit(count - 1))).drop("__place")
