import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import kernel as k
from geoloom.functions import st
from geoloom.operators.frame import GeoFrame
from geoloom.operators.grid import SquareGrid
from geoloom.plans import aggregate as agg
from geoloom.plans import script, select
from geoloom.sources.catalog import Catalog, DataSetExists, DataSetNotFound


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    return GeoFrame(df).to_box("x0", "y0", "x1", "y1")


def ids(frame, *cols):
    return sorted(tuple(r) for r in frame.df.select(*(cols or ["id"])).collect())


def test_selection_language():
    two = {"left": ["a", "g", "b"], "right": ["a", "h"]}
    one = {"": ["the_geom", "hcode", "x"]}
    pick = lambda t, s: [(p.namespace, p.column, p.alias) for p in select.parse(t, s)]
    assert pick("hcode as h, *-{hcode, x}", one) == [("", "hcode", "h"), ("", "the_geom", "the_geom")]
    assert pick("left.*-{g}, right.{a as ra, h}", two) == [("left", "a", "a"), ("left", "b", "b"), ("right", "a", "ra"), ("right", "h", "h")]
    for bad in ("nope", "*, x", "x as hcode, hcode", "*-{nope}", "x y"):
        with pytest.raises(ValueError):
            select.parse(bad, one)
    with pytest.raises(ValueError):
        select.parse("a", two)


def test_scripts(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "xy", 4.0)], "i int, s string, v double")
    kinds = {f.name: f.dataType for f in df.schema}
    run = lambda t: [r[0] for r in df.select(script.expression(t, kinds, {"k": 10}).alias("o")).collect()]
    assert run("s.substring(1, 3)") == ["bc", "y"]
    assert run("i == 1 || i > k") == [True, False]
    assert run("v == null ? 'none' : s + '!'") == ["none", "xy!"]
    assert run("String.format('m%02d', i)") == ["m01", "m02"]
    assert run("i / (i - 1)") == [None, 2.0]
    made = script.statements("i *= 3; if (v == null) { v = 0 } else if (v > 3) { v = v - 1; s = 'big' } // end", kinds)
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in sorted(made.items())]).collect()] == [(3, "abc", 0.0), (6, "big", 3.0)]
    for bad in ("i +", "nope == 1", "System.exit(1)", "s.foo()", "i = "):
        with pytest.raises(ValueError):
            script.statements(bad, kinds) if "=" in bad and "==" not in bad else script.expression(bad, kinds)


def test_columns(spark):
    f = GeoFrame(spark.createDataFrame([(1, "7"), (2, "x")], "id long, s string"))
    assert ids(f.define_column("t:double", "id * 2"), "id", "t") == [(1, 2.0), (2, 4.0)]
    with pytest.raises(ValueError):
        f.define_column("a:int, b:int")
    assert ids(f.assign_uid("u").distinct("u")) == [(1,), (2,)]
    assert ids(f.filter_script("s == 7")) == [(1,)]  # what can't be compared is dropped
    same = GeoFrame(spark.createDataFrame([(1, 5), (2, 5)], "id long, v int")).rescale("v")
    assert ids(same, "v") == [(None,), (None,)]
    with pytest.raises(ValueError):
        GeoFrame.union([f, f.project("id")])


def test_nulls_empties_and_touching(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0), (3, None, 0.0, 1.0, 1.0), (4, 50.0, 50.0, 60.0, 60.0), (5, 0.0, 0.0, 10.0, 10.0)]
    b = boxes(spark, rows)
    assert ids(b.spatial_join(b, "left.{id as a}, right.{id as b}"), "a", "b") == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 5), (4, 4), (5, 1), (5, 2), (5, 5)]
    far = boxes(spark, [(9, 20.0, 10.0, 21.0, 11.0)])
    assert ids(b.spatial_semi_join(far)) == [(2,)]
    assert ids(b.spatial_semi_join(far, negated=True)) == [(1,), (3,), (4,), (5,)]
    assert ids(b.filter_spatial((20.0, 10.0, 30.0, 30.0), negated=True)) == [(1,), (3,), (4,), (5,)]
    assert ids(b.difference_join(boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0)]))) == [(2,), (3,), (4,)]
    assert ids(b.arc_clip(boxes(spark, [(1, 5.0, 5.0, 6.0, 6.0)]))) == [(1,), (5,)]
    none = boxes(spark, [])
    assert ids(b.spatial_join(none)) == [] and len(ids(b.spatial_semi_join(none, negated=True))) == 5


@pytest.mark.parametrize("seed", range(3))
def test_bucketed_join_equals_nested_loops(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.choice([0, 1, 5, 90]) * rng.random(), y + rng.choice([0, 1, 5, 90]) * rng.random()) for i in range(n)]
    a, b = make(70), make(50)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for broadcast in (True, False):
        got = boxes(spark, a).spatial_join(boxes(spark, b), "left.{id as a}, right.{id as b}", broadcast=broadcast)
        assert ids(got, "a", "b") == want


def test_polygon_join_is_exact(spark):
    ring = k.to_wkb(k.from_wkt("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"))
    p = GeoFrame(spark.createDataFrame([(1, bytearray(ring)), (2, None)], "id long, g binary"), "g")
    assert ids(p.spatial_join(boxes(spark, [(7, 4.5, 4.5, 5.5, 5.5), (8, 3.0, 3.0, 4.0, 4.0)]), "right.id")) == [(8,)]


def test_grouping(spark):
    f = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (None, 0.0, 0.0, 1.0, 1.0)])
    out = f.aggregate_by_group("id", agg.union_geom("the_geom").alias("u"), agg.convex_hull("the_geom"), agg.envelope("the_geom"), agg.count().alias("n")).df
    got = {r.id: r for r in out.select("id", "n", st.BY_NAME["ST_Area"]("u").alias("u"), st.BY_NAME["ST_Area"]("convex_hull").alias("h"), "mbr").collect()}
    assert (got[1].u, got[1].h, got[1].n, got[1].mbr.xmax) == (2.0, 2.0, 2, 2.0) and got[None].u == 1.0
    assert f.filter_sql("id > 9").aggregate(agg.count(), agg.envelope("the_geom")).df.first()[0] == 0
    ordered = GeoFrame(spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("b", 2)], "k string, v int"))
    assert ids(ordered.take_by_group("k", 1, "v"), "k", "v") == [("a", None), ("b", 2)]
    assert ids(ordered.take_by_group("k", 1, "v:desc"), "k", "v") == [("a", 3), ("b", 2)]


def test_arc_buffer_joins_a_chain(spark):
    f = boxes(spark, [(i, i * 1.5, 0.0, i * 1.5, 0.0) for i in range(6)] + [(99, 100.0, 0.0, 100.0, 0.0)]).arc_buffer(1.0, dissolve=True)
    assert f.count() == 2 and f.columns == ["the_geom", "FID"]


def test_grid(spark):
    g = SquareGrid.parse("bounds=(0,0):(25,20);cell=10x10")
    assert g.width == 3 and SquareGrid((0, 0, 20, 20), (10, 10), 5).width == 3
    p = GeoFrame(spark.createDataFrame([(1, "5", "5"), (2, "10", "5"), (3, "90", "5"), (4, "", "1")], "id long, x string, y string")).to_point("x", "y")
    assert ids(p.assign_grid_cell(g), "id", "cell_id") == [(1, 0), (2, 0), (2, 1)]
    assert len(ids(p.assign_grid_cell(g, assign_outside=True))) == 5


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    f = GeoFrame(spark.range(100).selectExpr("id", "id * 1D AS x", "id % 10 * 1D AS y")).to_point("x", "y", srid="EPSG:4326")
    ds = cat.store(f, "a/points")
    assert (ds.count, ds.bounds) == (100, [0.0, 99.0, 0.0, 9.0]) and ds.length() > 0
    with pytest.raises(DataSetExists):
        cat.store(f, "a/points")
    assert cat.store(f, "a/points", append=True).count == 200
    assert cat.get("a/points").query((10.0, 0.0, 12.0, 9.0)).count() == 6
    assert cat.get_or_none("b") is None
    with pytest.raises(DataSetNotFound):
        cat.get("b")
    c = cat.get("a/points").cluster("a/clustered", cluster_bytes=4000.0)
    assert c.has_spatial_index and c.count == 200 and c.read().count() == 200
    assert c.query((10.0, 0.0, 12.0, 9.0)).count() == 6
    assert cat.store_by_key(f, "k", "y").read().count() == 100
    assert [d.id for d in cat.all()] == ["a/clustered", "a/points", "k"] and [d.id for d in cat.in_dir("", False)] == ["k"]
    from geoloom.cli import main

    assert main(["--root", str(tmp_path / "cat"), "list", "-r", "-l"]) == 0 and main(["--root", str(tmp_path / "cat"), "count", "k", "-v"]) == 0
    assert cat.delete_dir("a") == ["a/clustered", "a/points"] and cat.get_or_none("a/points") is None
    assert cat.create("e", f.schema, "the_geom").read().count() == 0
    assert f.df.filter(F.col("id") < 0).count() == 0


def test_catalog_parts_types_and_text(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    f = GeoFrame(spark.range(10).selectExpr("id", "id * 1D AS x", "1D AS y")).to_point("x", "y")
    cat.store(f, "p", partition_id="one")
    cat.store(f, "p", append=True, partition_id="two")
    again = cat.store(GeoFrame(f.df.filter("id < 5"), "the_geom"), "p", append=True, partition_id="two")  # a retry replaces
    assert again.count == 15 == again.read().count() and again.bounds == [0.0, 9.0, 1.0, 1.0]
    with pytest.raises(ValueError, match="differ"):
        cat.store(GeoFrame(f.df.withColumn("id", F.col("id").cast("int")), "the_geom"), "p", append=True)
    with pytest.raises(ValueError, match="unknown data set type"):
        cat.create("t", f.schema, type="OTHER")
    text = cat.store(GeoFrame(spark.createDataFrame([("a b",), ("c",)], "line string")), "t", type="TEXT")
    assert text.count == 2 and sorted(r.line for r in text.read().collect()) == ["a b", "c"]
    keyed = cat.store_by_key(GeoFrame(spark.createDataFrame([("007", 1), ("7", 2)], "k string, v int")), "k", "k")
    assert ids(keyed.read(), "k", "v") == [("007", 1), ("7", 2)]
    assert cat.read_files(str(tmp_path / "cat" / "t"), "text").count() == 2


def test_clustered_sets(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    f = GeoFrame(spark.range(180).selectExpr("id", "id * 2D - 180 AS x", "(id % 17) * 10D - 80 AS y")).to_point("x", "y", srid="EPSG:4326")
    keys = ["0", "1", "2", "30", "31", "32", "33"]
    ds = cat.store(f, "p").cluster("c", keys)
    assert ds.quad_keys() == keys and ds.count == 180 and sum(ds.info.clusters.values()) > 180  # edges lie in several
    left = boxes(spark, [(1, -180.0, 1.0, -91.0, 80.0), (2, -10.0, 5.0, 10.0, 15.0)])
    want = ids(left.spatial_join(f, "left.{id as a}, right.{id as b}"), "a", "b")
    assert want and ids(left.spatial_join(ds, "left.{id as a}, right.{id as b}"), "a", "b") == want
    near = ds.near(boxes(spark, [(1, -170.0, 20.0, -160.0, 30.0)]))
    assert 0 < near.count() < 80
    inside = cat.get("p").cluster("v", keys, valid=(-90.0, -80.0, 0.0, 80.0), bind_outlier=False, block_size=1 << 20)
    assert inside.count == f.filter_spatial((-90.0, -80.0, 0.0, 80.0)).count() and inside.info.block_size == 1 << 20
    assert cat.store(GeoFrame(f.df.limit(0), "the_geom", "EPSG:4326"), "none").cluster("nothing", keys).read().count() == 0
    parts = f.partition_by_quad_key(keys, count=4)
    seen = parts.df.select("quad_key", F.spark_partition_id().alias("p")).distinct().orderBy("quad_key").collect()
    assert [r.p for r in seen] == sorted(r.p for r in seen) and len({r.quad_key for r in seen}) == len(seen)


def test_failing_geometries(spark):
    f = GeoFrame(spark.createDataFrame([(1, None), (2, bytearray(b"\0"))], "id long, g binary"), "g")
    assert [r.c for r in f.centroid(output="c").collect()] == [None, None] == [r.c for r in f.buffer(1.0, "c").collect()]
    assert [r.g for r in GeoFrame(f.df, "g", "EPSG:4326").transform_crs("EPSG:3857").collect()] == [None, None]
    for strict in (f.centroid(throw_op_error=True), f.buffer(1.0, throw_op_error=True), GeoFrame(f.df, "g", "EPSG:4326").transform_crs("EPSG:3857", throw_op_error=True)):
        with pytest.raises(Exception):
            strict.collect()
    assert f.filter_spatial(GeoFrame(f.df.limit(0), "g")).count() == 0 and f.filter_spatial(GeoFrame(f.df.limit(0), "g"), negated=True).count() == 2
    assert f.aggregate(agg.union_geom("g").alias("u")).collect()[0].u is None


def test_rows_with_very_many_matches(spark, monkeypatch):
    from geoloom.operators import frame as module

    monkeypatch.setattr(module, "MATCHES", 3)
    left = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0), (2, 50.0, 50.0, 60.0, 60.0), (3, 90.0, 0.0, 91.0, 1.0)])
    right = boxes(spark, [(i, i * 1.0, i % 3 * 1.0, i + 1.5, i % 3 + 2.0) for i in range(30)])
    covered = {(x, y) for i in range(30) for x in range(20) for y in range(20) if i <= x / 2 < i + 1.5 and i % 3 <= y / 2 < i % 3 + 2}
    area = lambda f: {r.id: round(r.a, 6) for r in f.df.select("id", st.BY_NAME["ST_Area"](f._wkb()).alias("a")).collect()}
    assert area(left.difference_join(right)) == {1: 100 - len(covered) / 4, 2: 100.0, 3: 1.0}
    assert area(left.arc_clip(right)) == {1: len(covered) / 4}


def test_broadcast_is_checked(spark, monkeypatch):
    from geoloom.operators import sjoin

    a, b = boxes(spark, [(i, i * 1.0, 0.0, i + 2.0, 1.0) for i in range(20)]), boxes(spark, [(i, i * 2.0, 0.0, i * 2.0 + 1, 1.0) for i in range(10)])
    want = a.spatial_join(b, broadcast=False).count()
    plan = lambda f: f.df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(a.spatial_join(b, broadcast=True)) and a.spatial_join(b, broadcast=True).count() == want
    monkeypatch.setattr(sjoin, "FORCED_BYTES", 10)
    assert "broadcast" not in plan(a.spatial_join(b, broadcast=True)) and a.spatial_join(b, broadcast=True).count() == want
