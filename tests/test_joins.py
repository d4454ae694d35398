"""Hash joins over whole tables, and with unmatched rows on both sides."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import queries as q
from geoloom.functions import kernel as k
from geoloom.functions import st
from geoloom.operators import quadkey, sjoin
from geoloom.operators.frame import GeoFrame
from geoloom.runtime import tasks
from geoloom.sources import catalog

HOWS = ("inner", "left_outer", "right_outer", "full_outer", "semi")


@pytest.mark.parametrize("how", HOWS)
def test_no_row_is_kept_from_the_join(spark, how):
    d = "/root/testdata/sf0.001"
    keys = {r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect()}
    held = [r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_custkey").collect()]
    n = {"semi": len(keys & set(held)), "inner": sum(k in keys for k in held), "right_outer": len(held)}
    n["left_outer"] = n["inner"] + len(keys - set(held))
    n["full_outer"] = n["left_outer"] + sum(k not in keys for k in held)
    assert q.QUERIES[f"join_{how}_all"](spark, d).count() == n[how]


@pytest.mark.parametrize("how", HOWS)
def test_unmatched_rows_on_both_sides(spark, how):
    left, right = [(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], [(2, 20), (2, 21), (3, 30), (4, 40), (None, 50)]
    got = GeoFrame(spark.createDataFrame(left, "k long, name string")).hash_join("k", GeoFrame(spark.createDataFrame(right, "r long, v long")), "r", "left.name" if how == "semi" else "left.name, right.v", how).df.collect()
    both = [(a, v) for k, a in left for r, v in right if k is not None and k == r]
    alone_left, alone_right = [(a, None) for k, a in left if k not in (2, 3)], [(None, v) for r, v in right if r not in (2, 3)]
    want = {"inner": both, "left_outer": both + alone_left, "right_outer": both + alone_right, "full_outer": both + alone_left + alone_right, "semi": [("b",), ("c",), ("d",)]}[how]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _boxes(spark, rows):
    return GeoFrame(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")).to_box("x0", "y0", "x1", "y1")


def test_dense_sets_cost_few_exact_tests():
    """rows that are connected already are not compared again."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 20, 400), rng.uniform(0, 20, 400)
    box, calls = np.array([x, x + 3, y, y + 3]), []
    met = lambda i, j: bool(box[0][i] <= box[1][j] and box[0][j] <= box[1][i] and box[2][i] <= box[3][j] and box[2][j] <= box[3][i])
    links = sjoin.forest(range(400), box, np.ones(400, bool), lambda i, j: calls.append(1) or met(i, j))
    assert len(links) <= 399 and len(calls) <= 399 and len(links) == 400 - 1


def test_dissolved_sets_of_equal_empty_and_unlike_geometries(spark):
    """copies are one geometry, sets are those of all pairs, numbers are the sets' smallest."""
    rng = random.Random(5)
    rows = [(i, x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + rng.choice([0.1, 1, 3, 25]) * rng.random(), y + rng.choice([0.1, 1, 3]) * rng.random()) for i in range(60)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:20])] + [(200, None, 0.0, 1.0, 1.0), (201, None, 0.0, 1.0, 1.0)]
    made = [(k.buffer(k.box(r[1], r[2], r[3], r[4]), 0.5)) for r in rows[:80]]
    up = list(range(80))
    for i in range(80):
        for j in range(i):
            if up[i] != up[j] and k.intersects(made[i], made[j]):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    areas = sorted(round(k.area(k.union_all([m for m, u in zip(made, up) if u == c])), 4) for c in set(up))
    f = _boxes(spark, rows)
    f = GeoFrame(f.df.coalesce(1), f.geom).arc_buffer(0.5, dissolve=True)
    got = f.df.select("FID", st.BY_NAME["ST_Area"]("the_geom").alias("a")).collect()
    assert sorted(r.FID for r in got) == sorted(set(up) | {80, 81})
    assert sorted(round(r.a, 4) for r in got if r.a is not None) == areas and sum(r.a is None for r in got) == 2


def test_buffers_of_convex_rings():
    for text in ("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "POLYGON ((0 0, 0 3, 4 3, 0 0))"):
        g = k.from_wkt(text)
        segments = [k.buffer(k.Geom("LineString", g.parts[0][i : i + 2]), 0.7) for i in range(len(g.parts[0]) - 1)]
        assert k.area(k.buffer(g, 0.7)) == pytest.approx(k.area(k.union_all([g, *segments])), abs=1e-7)
    star = k.from_wkt("POLYGON ((0 0, 4 4, 0 3, 3 0, 3 4, 0 0))")
    assert not k._convex(star.parts[0])


def test_many_quad_keys_are_looked_up(spark, monkeypatch):
    """keys found by tiles are those that each row finds when it is held against all of them."""
    rng = random.Random(2)
    keys = ["".join(rng.choice("0123") for _ in range(rng.choice([1, 3, 5, 6]))) for _ in range(150)]
    keys = sorted(set(keys))
    edges = [quadkey.bounds(x) for x in rng.sample(keys, 20)]
    rows = [(i, a, b, a, b) for i, (a, b, _, _) in enumerate(edges)] + [(20 + i, *e) for i, e in enumerate(edges)]
    rows += [(40 + i, x := rng.uniform(-190, 180), y := rng.uniform(-89, 89), x + rng.choice([0, 1, 300]) * rng.random(), y + rng.choice([0, 1, 50]) * rng.random()) for i in range(200)] + [(900, None, 0.0, 1.0, 1.0)]
    f, got = _boxes(spark, rows), []
    for few in (0, 10**6):
        monkeypatch.setattr(quadkey, "FEW_KEYS", few)
        for owner in (False, True):
            got.append(sorted(tuple(r) for r in f.attach_quad_key(keys, owner_only=owner).df.select("id", "quad_key").collect()))
    assert got[:2] == got[2:] and len(got[0]) > len(got[1]) == 241
    monkeypatch.setattr(quadkey, "FEW_KEYS", 64)
    many = f.partition_by_quad_key(keys, count=5).df
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "map" not in plan.lower().split("quad_key")[0]


@pytest.mark.parametrize("forced", (True, False))
@pytest.mark.parametrize("relation, dist", (("intersects", 0.0), ("contains", 0.0), ("within", 0.0), ("within_distance", 1.5)))
def test_much_work_is_dealt_to_many_tasks(spark, monkeypatch, relation, dist, forced):
    """F4, F8, F9, F11, F12: a left side of one file or of one crowded cell is not one task's, and each pair comes once."""
    monkeypatch.setattr(sjoin, "MUCH_WORK", 10)
    rng = random.Random(4)
    a = [(i, x := rng.choice([5.0, 5.0, rng.uniform(0, 40)]), y := rng.choice([5.0, rng.uniform(0, 40)]), x + rng.choice([0, 4]), y + rng.choice([0, 4])) for i in range(80)]
    b = [(i, x := rng.uniform(0, 30), y := rng.uniform(0, 30), x + rng.choice([2, 3.5, 20]), y + rng.choice([1, 4])) for i in range(60)]
    gap = lambda p, q: (max(q[1] - p[3], p[1] - q[3], 0) ** 2 + max(q[2] - p[4], p[2] - q[4], 0) ** 2) ** 0.5
    inside = lambda p, q: p[1] <= q[1] and q[3] <= p[3] and p[2] <= q[2] and q[4] <= p[4]
    test = {"intersects": lambda p, q: gap(p, q) == 0, "contains": inside, "within": lambda p, q: inside(q, p), "within_distance": lambda p, q: gap(p, q) <= dist}[relation]
    left, right = _boxes(spark, a), _boxes(spark, b)
    left = GeoFrame(left.df.coalesce(1), left.geom)
    out = left.spatial_join(right, "left.{id as a}, right.{id as b}", relation, dist, broadcast=forced)
    assert sorted(map(tuple, out.df.collect())) == sorted((p[0], q[0]) for p in a for q in b if test(p, q))
    assert out.df.rdd.getNumPartitions() == tasks(spark)


def test_points_within_a_distance_stay_in_one_cell(spark):
    """the boxes grow, not the points."""
    p = GeoFrame(spark.createDataFrame([(1, 3.5, 2.0), (2, 0.1 + 0.2, 0.0), (3, 3.6, 2.0)], "id long, x double, y double")).to_point("x", "y")
    out = p.spatial_join(_boxes(spark, [(7, 0.0, 0.0, 2.0, 2.0)]), "left.id", "within_distance", 1.5)
    assert sorted(r.id for r in out.df.collect()) == [1, 2]


@pytest.mark.parametrize("seed", range(2))
def test_rows_with_a_match_make_no_pairs(spark, monkeypatch, seed):
    """semi and anti joins of native geometries compare with few boxes a cell, however many cover it."""
    rng = random.Random(seed)
    grid = lambda lo, hi: rng.choice([rng.uniform(lo, hi), float(rng.randint(lo, hi))])
    a = [(i, x := grid(-30, 60), y := grid(-30, 60), x + rng.choice([0, 0, 2, 40]), y + rng.choice([0, 0, 2])) for i in range(150)] + [(999, None, 0.0, 1.0, 1.0)]
    b = [(i, x := grid(-20, 40), y := grid(-20, 40), x + rng.choice([0, 1, 6, 30]), y + rng.choice([0, 1, 6])) for i in range(60)]
    b += [(100 + i, *r[1:]) for i, r in enumerate(b)]
    want = sorted((p[0],) for p in a if p[1] is not None and any(p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4] for q in b))
    left, right = _boxes(spark, a), _boxes(spark, b)
    points = GeoFrame(left.df.drop("the_geom")).to_point("x0", "y0")
    met = sorted((p[0],) for p in a if p[1] is not None and any(q[1] <= p[1] <= q[3] and q[2] <= p[2] <= q[4] for q in b))
    monkeypatch.setattr(sjoin, "pairs", None)
    for key in ("id", None):
        for f, ids in ((left, want), (points, met)):
            assert sorted(map(tuple, f.spatial_semi_join(right, key=key).df.select("id").collect())) == ids
            rest = sorted((p[0],) for p in a if (p[0],) not in ids)
            assert sorted(map(tuple, f.spatial_semi_join(right, negated=True, key=key).df.select("id").collect())) == rest


def test_covered_cells_hold_few_boxes(spark):
    rows = _boxes(spark, [(i, -1.0 - i / 100, -1.0, 9.0 + i / 100, 9.0) for i in range(300)])
    size = 4.0
    r = sjoin._prepared(rows.df.select("the_geom"), "the_geom", "r").withColumn("r_level", sjoin._level("r", size))
    cells = sjoin._covering(sjoin._cells(r, "r", size, 1), size)
    assert cells.groupBy("level", "cx", "cy").count().agg({"count": "max"}).first()[0] <= 2


@pytest.mark.parametrize("name", ("st_difference_union", "st_intersection", "st_measures", "st_distance", "st_interior_hull_envelope", "frame_intersection", "buffer_centroid"))
def test_geometry_functions_of_one_file_are_many_tasks(spark, name):
    """a small file is one task's, and its rows' geometry is not."""
    assert q.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks(spark)


def test_tasks_grow_with_the_work_of_a_join(spark, monkeypatch):
    """F8, F9, F11, F12: a task compares a bounded number of pairs."""
    monkeypatch.setattr(sjoin, "MUCH_WORK", 10)
    monkeypatch.setattr(sjoin, "TASK_WORK", 20)
    b = _boxes(spark, [(i, i % 7 * 1.0, i % 5 * 1.0, i % 7 + 2.0, i % 5 + 2.0) for i in range(60)])
    for forced in (True, False):
        out = b.spatial_join(b, "left.{id as a}, right.{id as b}", broadcast=forced)
        assert out.df.rdd.getNumPartitions() > 2 * tasks(spark)
    assert out.count() == sum(abs(i % 7 - j % 7) <= 2 and abs(i % 5 - j % 5) <= 2 for i in range(60) for j in range(60))


def test_plain_numbers_are_not_read_as_text(spark):
    """filters on a point of doubles or integers, which are pushed down, cast nothing to strings; strings still count."""
    df = spark.createDataFrame([(1, 2.5, 3, " 4.5"), (2, None, 3, ""), (3, float("nan"), -1, "x")], "id long, x double, n int, s string")
    f = GeoFrame(df).to_point("x", "n")
    kept = f.df.filter("the_geom.x - 0D IS NOT NULL")
    assert "string" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, str(r.the_geom.x), r.the_geom.y) for r in kept.collect()] == [(1, "2.5", 3.0), (3, "nan", -1.0)]
    texts = GeoFrame(df.filter("id < 3")).to_point("n", "s").df.collect()
    assert [tuple(r.the_geom) if r.the_geom else None for r in texts] == [(3.0, 4.5), None]


def test_equal_geometries_are_buffered_once(spark, monkeypatch):
    """a dissolved buffer costs a geometry for each distinct one; nulls keep a row and a number each."""
    rows = [(i, *b) for i, b in enumerate([(0.0, 0.0, 1.0, 1.0), (9.0, 9.0, 10.0, 10.0), (0.5, 0.0, 2.0, 1.0)] * 20 + [(None, 0.0, 1.0, 1.0)] * 3)]
    plain, seen = GeoFrame.buffer, []
    monkeypatch.setattr(GeoFrame, "buffer", lambda f, *a, **k: seen.append(f.df.count()) or plain(f, *a, **k))
    f = _boxes(spark, rows)
    got = GeoFrame(f.df.coalesce(1), f.geom).arc_buffer(0.25, dissolve=True).df.select("FID", F.isnull("the_geom")).collect()
    assert seen == [4] and sorted(map(tuple, got)) == [(0, False), (1, False), (60, True), (61, True), (62, True)]


def test_a_crowded_tile_of_a_large_set_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """neither one file nor one tile is one task's; the rows and their owners stay the same."""
    monkeypatch.setattr(catalog, "MUCH_BYTES", 1_000)
    f = GeoFrame(spark.range(400).coalesce(1).selectExpr("id", "1D + id % 9 AS x", "2D AS y")).to_point("x", "y", srid="EPSG:4326")
    ds = catalog.Catalog(spark, f"file://{tmp_path}/c").store_clustered(f, "tiles", q.TILES)
    files = [p for p in tmp_path.rglob("*.parquet")]
    assert len(files) > 1 and len({p.parent for p in files}) == 1 and ds.info.owned == 400
    assert sorted(r.id for r in ds.read().df.collect()) == list(range(400))
