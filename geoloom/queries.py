"""The registered queries of the spatial engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import st
from .operators import quadkey
from .operators.frame import GeoFrame
from .operators.grid import SquareGrid, shared_area
from .plans import aggregate as agg
from .runtime import scratch, ship
from .sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> GeoFrame:
    return GeoFrame(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# -- derived geometry, see FIXTURES.md


def customer_points(spark: SparkSession, d: str) -> GeoFrame:
    df = table(spark, d, "customer").df.selectExpr("c_custkey AS id", "c_acctbal / 100D AS x", "(c_custkey % 1000) / 10D AS y")
    return GeoFrame(df).to_point("x", "y")


def lineitem_points(spark: SparkSession, d: str) -> GeoFrame:
    df = table(spark, d, "lineitem").df.selectExpr("l_orderkey", "l_linenumber", "l_quantity AS x", "l_extendedprice / 2000D AS y")
    return GeoFrame(df).to_point("x", "y")


def nation_boxes(spark: SparkSession, d: str) -> GeoFrame:
    df = table(spark, d, "nation").df.selectExpr("n_nationkey AS id", "(n_nationkey % 5) * 20D AS x0", "floor(n_nationkey / 5D) * 20D AS y0")
    return GeoFrame(df.selectExpr("*", "x0 + 20D AS x1", "y0 + 20D AS y1")).to_box("x0", "y0", "x1", "y1")


def supplier_boxes(spark: SparkSession, d: str) -> GeoFrame:
    df = table(spark, d, "supplier").df.selectExpr("s_suppkey AS id", "s_acctbal / 100D AS x0", "((s_suppkey * 37) % 100) * 1D AS y0", "s_nationkey")
    df = df.selectExpr("id", "x0", "y0", "x0 + 5D + (s_nationkey % 5) AS x1", "y0 + 4D + (s_nationkey % 7) AS y1")
    return GeoFrame(df).to_box("x0", "y0", "x1", "y1")


def event_places(spark: SparkSession, d: str) -> GeoFrame:
    df = table(spark, d, "events").df.selectExpr("event_id AS id", "((user_id * 7919) % 36000) / 100D - 180D AS x", "((event_id * 104729) % 17000) / 100D - 85D AS y")
    return GeoFrame(df).to_point("x", "y", srid="EPSG:4326")


GRID = SquareGrid((0.0, 0.0, 100.0, 100.0), (10.0, 10.0))
PTS = "SELECT c_custkey AS id, c_acctbal / 100.0 AS x, (c_custkey % 1000) / 10.0 AS y FROM customer"
NBOX = "SELECT n_nationkey AS id, (n_nationkey % 5) * 20.0::DOUBLE AS x0, floor(n_nationkey / 5.0) * 20.0::DOUBLE AS y0, (n_nationkey % 5) * 20.0::DOUBLE + 20 AS x1, floor(n_nationkey / 5.0) * 20.0::DOUBLE + 20 AS y1 FROM nation"
SBOX = "SELECT id, x0, y0, x0 + 5 + nk % 5 AS x1, y0 + 4 + nk % 7 AS y1 FROM (SELECT s_suppkey AS id, s_acctbal / 100.0 AS x0, ((s_suppkey * 37) % 100) * 1.0::DOUBLE AS y0, s_nationkey AS nk FROM supplier)"
MEET = "p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1"
OVER = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


# -- filters, projection, columns


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND (l_returnflag = 'R' OR l_returnflag = 'A')")
def filter_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter_script("l_quantity >= low && (l_returnflag == 'R' || l_returnflag == 'A')", {"low": 45}).project("l_orderkey, l_linenumber, l_quantity").df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
def filter_sql(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter_sql("o_totalprice > 200000 AND o_orderstatus <> 'F'").project("o_orderkey, o_totalprice").df


@query("SELECT l_orderkey AS okey, l_linenumber, l_suppkey AS supp FROM lineitem")
def project_select(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").project("l_orderkey as okey, l_linenumber, l_suppkey as supp").df


@query("SELECT p_partkey, p_brand, p_size FROM part")
def project_without(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").project("*-{p_name, p_type, p_retailprice}").df


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_size * 2 + 1 AS twice, NULL::BIGINT AS later FROM part")
def define_column(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").define_column("twice:int", "p_size * 2 + 1").define_column("later:long").define_column("p_size:string")
    return f.project("p_partkey, p_size, twice, later").df


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, CASE WHEN o_totalprice >= 100000 THEN 'big' WHEN o_totalprice >= 50000 THEN 'mid' ELSE 'small' END AS size, 'P-' || substr(o_orderpriority, 1, 1) AS tag FROM orders")
def expand_script(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").update_sql("o_orderdate", "string(o_orderdate)")
    script = "y = o_orderdate.substring(0, 4); if (o_totalprice >= 100000) { size = 'big' } else if (o_totalprice >= 50000) { size = 'mid' } else { size = 'small' }; tag = String.format('P-%s', o_orderpriority.substring(0, 1))"
    return f.expand("y:int, size:string, tag:string", script).project("o_orderkey, y, size, tag").df


@query("SELECT p_partkey, greatest(p_size * 2, 20)::INT AS p_size, upper(p_brand) AS p_brand FROM part")
def update_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").update_script("p_size *= 2; p_size = Math.max(p_size, 20); p_brand = p_brand.toUpperCase();").project("p_partkey, p_size, p_brand").df


@query("SELECT p_partkey, p_retailprice * 2 AS p_retailprice FROM part")
def update_sql(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").update_sql("p_retailprice", "p_retailprice * 2").project("p_partkey, p_retailprice").df


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, 0) AS ck FROM orders")
def fill_na(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").update_sql("ck", "IF(o_orderkey % 3 <> 0, o_custkey, NULL)").fill_na("ck", 0).project("o_orderkey, ck").df


@query("SELECT count(*) AS n, count(*) AS distinct_ids FROM orders")
def assign_uid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").assign_uid("uid").df.agg(F.count("uid").alias("n"), F.count_distinct("uid").alias("distinct_ids"))


@query()
def sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").sample(0.1, 42).project("o_orderkey").df


@query("SELECT p_partkey, round((p_size - lo) / (hi - lo)::DOUBLE, 12) AS p_size FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def rescale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rescale("p_size").project("p_partkey, p_size").update_sql("p_size", "round(p_size, 12)").df


# -- grouping


@query("SELECT count(*) AS count, round(sum(l_quantity), 2) AS qty, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_discount), 6) AS disc FROM lineitem")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").aggregate(agg.count(), agg.sum_("l_quantity").alias("qty"), agg.min_("l_shipdate").alias("first"), agg.max_("l_shipdate").alias("last"), agg.avg("l_discount").alias("disc"))
    return f.update_sql("qty", "round(qty, 2)").update_sql("disc", "round(disc, 6)").df


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY ALL")
def agg_by_group(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").aggregate_by_group("l_returnflag, l_linestatus", agg.count().alias("n"), agg.sum_("l_quantity").alias("sum_qty"), agg.avg("l_extendedprice").alias("avg_price"), agg.min_("l_discount").alias("lo"), agg.max_("l_discount").alias("hi"))
    return f.update_sql("sum_qty", "round(sum_qty, 2)").update_sql("avg_price", "round(avg_price, 4)").df


@query("SELECT n_nationkey, any_value(n_name) AS n_name, count(*) AS count FROM nation GROUP BY n_nationkey")
def agg_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").aggregate_by_group("n_nationkey", agg.count(), tags="n_name").df


@query("SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd FROM part GROUP BY p_brand")
def agg_stddev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").aggregate_by_group("p_brand", agg.stddev("p_retailprice").alias("sd")).update_sql("sd", "round(sd, 4)").df


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def concat_str(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").aggregate_by_group("n_regionkey", agg.concat_str("n_name", "|").alias("names")).df


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def take_by_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").take_by_group("o_custkey", 2, "o_totalprice:desc, o_orderkey").project("o_custkey, o_orderkey, o_totalprice").df


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").distinct("l_suppkey, l_returnflag").project("l_suppkey, l_returnflag").df


@query("SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def pivot_sum(spark: SparkSession, d: str) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    f = table(spark, d, "events").pivot("user_id", "event_type", agg.sum_("value"), names)
    return f.df.select("user_id", *[F.round(n, 4).alias(n) for n in names])


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").project("n_name as name")
    return GeoFrame.union([n, table(spark, d, "region").project("r_name as name"), n]).df


# -- joins


def _join(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        left = table(spark, d, "customer").filter_sql("c_custkey % 2 = 0")
        right = table(spark, d, "orders").filter_sql("o_totalprice > 150000")
        out = "left.{c_custkey, c_name}" if how == "semi" else "left.{c_custkey, c_name}, right.{o_orderkey as okey}"
        return left.hash_join("c_custkey", right, "o_custkey", out, how).df

    return run


for _how, _sql in {"inner": "JOIN", "left_outer": "LEFT JOIN", "right_outer": "RIGHT JOIN", "full_outer": "FULL JOIN", "semi": "SEMI JOIN"}.items():
    QUERIES[f"join_{_how}"] = _join(_how)
    SQL[f"join_{_how}"] = f"SELECT c_custkey, c_name{'' if _how == 'semi' else ', o_orderkey AS okey'} FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c {_sql} (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey"


def _whole_join(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = "left.{c_custkey, c_name}" if how == "semi" else "left.{c_custkey, c_name}, right.{o_orderkey as okey}"
        return table(spark, d, "customer").hash_join("c_custkey", table(spark, d, "orders"), "o_custkey", out, how).df

    return run


for _how, _sql in {"inner": "JOIN", "left_outer": "LEFT JOIN", "right_outer": "RIGHT JOIN", "full_outer": "FULL JOIN", "semi": "SEMI JOIN"}.items():
    QUERIES[f"join_{_how}_all"] = _whole_join(_how)
    SQL[f"join_{_how}_all"] = f"SELECT c_custkey, c_name{'' if _how == 'semi' else ', o_orderkey AS okey'} FROM customer c {_sql} orders o ON c_custkey = o_custkey"


# -- functions


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding), 6) AS mean FROM embeddings")
def array_avg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").df.select("vec_id", F.round(st.array_avg(F.col("embedding")), 6).alias("mean"))


@query("SELECT p_partkey, starts_with(p_type, 'ECONOMY') AS economy FROM part")
def st_starts_with(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").df.select("p_partkey", st.starts_with(F.col("p_type"), F.lit("ECONOMY")).alias("economy"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - 25.0) ** 2 + (l_extendedprice / 2000.0 - 25.0) ** 2), 6) AS dist FROM lineitem")
def to_point_distance(spark: SparkSession, d: str) -> DataFrame:
    g = lineitem_points(spark, d).df
    return g.select("l_orderkey", "l_linenumber", F.round(F.sqrt((F.col("the_geom.x") - 25.0) ** 2 + (F.col("the_geom.y") - 25.0) ** 2), 6).alias("dist"))


@query(f"WITH p AS ({PTS}) SELECT id, round(sqrt((x - 50.0) ** 2 + (y - 50.0) ** 2), 6) AS dist FROM p")
def st_distance(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    g = customer_points(spark, d).spread().df
    return g.select("id", F.round(st.BY_NAME["ST_Distance"](st.wkb(F.col("the_geom"), st.POINT), st.BY_NAME["ST_Point"](F.lit(50.0), F.lit(50.0))), 6).alias("dist"))


@query(f"WITH b AS ({SBOX}) SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * (x1 - x0 + y1 - y0), 6) AS length, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM b")
def st_measures(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    b = supplier_boxes(spark, d).spread().df.withColumn("g", st.wkb(F.col("the_geom"), st.ENVELOPE))
    c = st.envelope(st.BY_NAME["ST_Centroid"](F.col("g")), st._binary)
    return b.select("id", F.round(st.BY_NAME["ST_Area"]("g"), 6).alias("area"), F.round(st.BY_NAME["ST_Length"]("g"), 6).alias("length"), c.alias("c")).select("id", "area", "length", F.round("c.xmin", 6).alias("cx"), F.round("c.ymin", 6).alias("cy"))


@query("SELECT n_nationkey AS id, 'POINT (' || n_nationkey || ' ' || n_regionkey || ')' AS wkt FROM nation")
def st_as_text(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "nation").df.select(F.col("n_nationkey").alias("id"), st.BY_NAME["ST_AsText"](st.BY_NAME["ST_Point"](F.col("n_nationkey"), F.col("n_regionkey"))).alias("wkt"))


@query("SELECT n_nationkey AS id, 'POINT (' || n_nationkey || ' ' || n_regionkey || ')' AS a, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || '.0,' || n_regionkey || '.0]}' AS b, true AS c FROM nation")
def st_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered names, called from SQL."""
    ship(spark)
    st.register(spark)
    table(spark, d, "nation").df.createOrReplaceTempView("geoloom_nation")
    text = "concat('POINT (', n_nationkey, ' ', n_regionkey, ')')"
    return spark.sql(f"""
        SELECT n_nationkey AS id, ST_AsText(ST_GeomFromGeoJSON(ST_AsGeoJSON(ST_GeomFromText({text})))) AS a, ST_AsGeoJSON(ST_GeomFromWKB(ST_AsBinary(ST_GeomFromText({text})))) AS b,
               ST_Intersects(ST_Buffer(ST_GeomFromText({text}), 2D), ST_GeomFromText({text})) AS c
        FROM geoloom_nation""")  # fmt: skip


@query(f"WITH a AS ({SBOX}), b AS ({NBOX}) SELECT a.id, b.id AS nation, {OVER} AS meet FROM a JOIN b ON a.id % 25 = b.id")
def envelope_intersects(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_boxes(spark, d).df, nation_boxes(spark, d).df.select(F.col("id").alias("nation"), F.col("the_geom").alias("other"))
    return a.join(b, F.col("id") % 25 == F.col("nation")).select("id", F.col("nation"), st.envelopes_meet(F.col("the_geom"), F.col("other")).alias("meet"))


@query(f"WITH p AS ({PTS}) SELECT id % 7 AS k, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM p GROUP BY k")
def envelope_agg(spark: SparkSession, d: str) -> DataFrame:
    f = customer_points(spark, d).update_sql("k", "id % 7").aggregate_by_group("k", agg.envelope("the_geom"))
    return f.df.select("k", "mbr.*")


@query(f"WITH p AS ({PTS}) SELECT id, x, y FROM p WHERE x BETWEEN 20 AND 40 AND y BETWEEN 30 AND 60")
def box_filter(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).filter_spatial((20.0, 30.0, 40.0, 60.0)).project("id, x, y").df


@query(f"WITH p AS ({PTS}) SELECT id, x, y FROM p WHERE NOT (x BETWEEN 20 AND 40 AND y BETWEEN 30 AND 60)")
def box_filter_negated(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).filter_spatial((20.0, 30.0, 40.0, 60.0), negated=True).project("id, x, y").df


@query(f"WITH b AS ({SBOX}) SELECT id, round((least(x1, 60) - greatest(x0, 40)) * (least(y1, 60) - greatest(y0, 40)), 6) AS area FROM b WHERE x0 < 60 AND x1 > 40 AND y0 < 60 AND y1 > 40")
def st_intersection(spark: SparkSession, d: str) -> DataFrame:
    """On WKB, by the overlay."""
    ship(spark)
    fixed = st.BY_NAME["ST_GeomFromText"](F.lit("POLYGON ((40 40, 60 40, 60 60, 40 60, 40 40))"))
    b = supplier_boxes(spark, d).spread().df.withColumn("g", st.BY_NAME["ST_Intersection"](st.wkb(F.col("the_geom"), st.ENVELOPE), fixed))
    return b.withColumn("area", F.round(st.BY_NAME["ST_Area"]("g"), 6)).filter("area > 0").select("id", "area")


@query(f"WITH b AS ({SBOX}) SELECT id, round((x1 - x0) * (y1 - y0) - greatest(least(x1, 60) - greatest(x0, 40), 0) * greatest(least(y1, 60) - greatest(y0, 40), 0), 6) AS less, round((x1 - x0) * (y1 - y0) + 400 - greatest(least(x1, 60) - greatest(x0, 40), 0) * greatest(least(y1, 60) - greatest(y0, 40), 0), 6) AS both FROM b")
def st_difference_union(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    fixed = st.BY_NAME["ST_GeomFromText"](F.lit("POLYGON ((40 40, 60 40, 60 60, 40 60, 40 40))"))
    g = st.wkb(F.col("the_geom"), st.ENVELOPE)
    area = st.BY_NAME["ST_Area"]
    return supplier_boxes(spark, d).spread().df.select("id", F.round(area(st.BY_NAME["ST_Difference"](g, fixed)), 6).alias("less"), F.round(area(st.BY_NAME["ST_Union"](g, fixed)), 6).alias("both"))


@query(f"WITH p AS ({PTS}) SELECT id, round(16 * sin(pi() / 16) * 4, 6) AS area, round(x, 6) AS cx, round(y, 6) AS cy FROM p")
def buffer_centroid(spark: SparkSession, d: str) -> DataFrame:
    f = customer_points(spark, d).spread().buffer(2.0, "ring")
    f = f.centroid(output="c")
    e = st.envelope(F.col("c"), st._binary)
    return f.df.select("id", F.round(st.BY_NAME["ST_Area"]("ring"), 6).alias("area"), e.alias("e")).select("id", "area", F.round("e.xmin", 6).alias("cx"), F.round("e.ymin", 6).alias("cy"))


@query("SELECT n_regionkey, round((max(x) - min(x) + 20) * (max(y) - min(y) + 20), 4) >= round(count(*) * 400.0, 4) AS wide FROM (SELECT n_regionkey, (n_nationkey % 5) * 20.0 AS x, floor(n_nationkey / 5.0) * 20.0 AS y FROM nation) GROUP BY n_regionkey")
def convex_hull_agg(spark: SparkSession, d: str) -> DataFrame:
    """The hull of boxes holds them all: its envelope's area is at least theirs."""
    n = table(spark, d, "nation").df.select("n_nationkey", "n_regionkey")
    b = nation_boxes(spark, d).df
    f = GeoFrame(b.join(n, b.id == n.n_nationkey), "the_geom").aggregate_by_group("n_regionkey", agg.convex_hull("the_geom"), agg.count().alias("n"))
    e = st.envelope(F.col("convex_hull"), st._binary)
    return f.df.select("n_regionkey", "n", e.alias("e")).select("n_regionkey", (F.expr("(e.xmax - e.xmin) * (e.ymax - e.ymin)") >= F.col("n") * 400 - 1e-6).alias("wide"))


@query("SELECT n_nationkey % 5 AS k, 2000.0::DOUBLE AS area, count(*) AS n FROM nation GROUP BY k")
def union_geom_agg(spark: SparkSession, d: str) -> DataFrame:
    """A column of the tiling melts into one strip."""
    f = nation_boxes(spark, d).update_sql("k", "id % 5").aggregate_by_group("k", agg.union_geom("the_geom").alias("u"), agg.count().alias("n"))
    return f.df.select("k", F.round(st.BY_NAME["ST_Area"]("u"), 4).alias("area"), "n")


@query("SELECT event_id AS id, round(radians(((user_id * 7919) % 36000) / 100.0 - 180.0) * 6378137.0, 3) AS mx, round(ln(tan(pi() / 4 + radians(((event_id * 104729) % 17000) / 100.0 - 85.0) / 2)) * 6378137.0, 3) + 0.0 AS my FROM events")
def transform_crs(spark: SparkSession, d: str) -> DataFrame:
    f = event_places(spark, d).transform_crs("EPSG:3857")
    return f.df.select("id", F.round("the_geom.x", 3).alias("mx"), (F.round("the_geom.y", 3) + 0.0).alias("my"))


# -- grid


@query(f"WITH p AS ({PTS}), c AS (SELECT x.i AS cx, y.i AS cy FROM range(-1, 11) x(i), range(-1, 11) y(i)) SELECT id, cx AS cell_x, cy AS cell_y, cy * 10 + cx AS cell_id FROM p JOIN c ON p.x BETWEEN cx * 10.0 AND cx * 10.0 + 10 AND p.y BETWEEN cy * 10.0 AND cy * 10.0 + 10 WHERE p.x BETWEEN 0 AND 100 AND p.y BETWEEN 0 AND 100")
def grid_points(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).assign_grid_cell(GRID).df.select("id", F.col("cell_pos.x").cast("long").alias("cell_x"), F.col("cell_pos.y").cast("long").alias("cell_y"), "cell_id")


@query(f"WITH b AS ({SBOX}), c AS (SELECT x.i AS cx, y.i AS cy FROM range(-3, 15) x(i), range(-3, 15) y(i)) SELECT id, cy * 10 + cx AS cell_id FROM b JOIN c ON b.x0 <= cx * 10.0 + 10 AND cx * 10.0 <= b.x1 AND b.y0 <= cy * 10.0 + 10 AND cy * 10.0 <= b.y1 WHERE b.x0 <= 100 AND b.x1 >= 0 AND b.y0 <= 100 AND b.y1 >= 0")
def grid_boxes(spark: SparkSession, d: str) -> DataFrame:
    return supplier_boxes(spark, d).assign_grid_cell(GRID).project("id, cell_id").df


@query(f"WITH b AS ({SBOX}), c AS (SELECT x.i AS cx, y.i AS cy FROM range(-3, 15) x(i), range(-3, 15) y(i)) SELECT cy * 10 + cx AS cell_id, round(sum((least(b.x1, cx * 10.0 + 10) - greatest(b.x0, cx * 10.0)) * (least(b.y1, cy * 10.0 + 10) - greatest(b.y0, cy * 10.0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) * b.id), 5) AS weight FROM b JOIN c ON b.x0 < cx * 10.0 + 10 AND cx * 10.0 < b.x1 AND b.y0 < cy * 10.0 + 10 AND cy * 10.0 < b.y1 WHERE b.x0 <= 100 AND b.x1 >= 0 AND b.y0 <= 100 AND b.y1 >= 0 GROUP BY cell_id")
def areal_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """A box's value is shared among the cells by area."""
    f = supplier_boxes(spark, d).assign_grid_cell(GRID).df
    part = shared_area(F.col("the_geom"), F.col("cell_geom")) / F.expr("(x1 - x0) * (y1 - y0)")
    return f.withColumn("part", part).filter("part > 0").groupBy("cell_id").agg(F.round(F.sum(F.col("part") * F.col("id")), 5).alias("weight"))


# -- quad keys


_TILE = "SELECT event_id AS id, least(greatest(floor((lon + 180) / 360 * 1024), 0), 1023)::BIGINT AS tx, least(greatest(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 1024), 0), 1023)::BIGINT AS ty FROM (SELECT event_id, ((user_id * 7919) % 36000) / 100.0 - 180 AS lon, ((event_id * 104729) % 17000) / 100.0 - 85 AS lat FROM events)"
_KEY = " || ".join(f"((tx >> {b}) & 1 | (((ty >> {b}) & 1) << 1))::VARCHAR" for b in range(9, -1, -1))


@query(f"SELECT id, {_KEY} AS quad_key FROM ({_TILE})")
def quadkey_of(spark: SparkSession, d: str) -> DataFrame:
    g = event_places(spark, d).df
    return g.select("id", quadkey.quad_key(quadkey.tile_x(F.col("the_geom.x"), 10), quadkey.tile_y(F.col("the_geom.y"), 10), 10).alias("quad_key"))


_LON, _LAT = "(((user_id * 7919) % 36000) / 100.0 - 180)", "(((event_id * 104729) % 17000) / 100.0 - 85)"
_BOUNDS = ", ".join("('{}', {!r}, {!r}, {!r}, {!r})".format(k, *quadkey.bounds(k)) for k in (a + b for a in "0123" for b in "0123"))


@query(f"SELECT quad_key, count(*) AS n, count_if(quad_key = owner) AS owned FROM (SELECT t.k AS quad_key, min(t.k) OVER (PARTITION BY event_id) AS owner FROM events JOIN (VALUES {_BOUNDS}) t(k, a, b, c, d) ON {_LON} BETWEEN a AND c AND {_LAT} BETWEEN b AND d) GROUP BY quad_key")
def quadkey_attach(spark: SparkSession, d: str) -> DataFrame:
    """Every tile that a place meets, two and more on edges, and the first one as its owner."""
    keys = [a + b for a in "0123" for b in "0123"]
    f = event_places(spark, d)
    all_, own = (f.attach_quad_key(keys, owner_only=o).df.groupBy("quad_key").agg(F.count(F.lit(1)).alias(n)) for o, n in ((False, "n"), (True, "owned")))
    return all_.join(own, "quad_key", "left").na.fill(0, ["owned"])


@query("SELECT count(*) AS rows, true AS bounded FROM events")
def quadkey_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that hold each place once, none with more than a limit."""
    f = event_places(spark, d)
    n = f.df.count()
    keys = f.estimate_quad_keys(cluster_bytes=128.0 * max(1, n // 20))
    per = f.partition_by_quad_key(keys, count=8).df.groupBy("quad_key").agg(F.count_distinct("id").alias("n"))
    inside = f.attach_quad_key(keys, owner_only=True).df
    return per.agg(F.max("n").alias("m")).select((F.col("m") <= max(1, n // 20) + n // 50 + 5).alias("bounded")).join(inside.agg(F.count_distinct("id").alias("rows")), F.lit(True))


# -- spatial joins


@query(f"WITH p AS ({PTS}), b AS ({NBOX}) SELECT p.id AS pid, b.id AS bid FROM p JOIN b ON {MEET}")
def sjoin_point_box(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).spatial_join(nation_boxes(spark, d), "left.{id as pid}, right.{id as bid}", broadcast=False).df


@query(f"WITH p AS ({PTS}), b AS ({SBOX}) SELECT b.id AS bid, count(*) AS n FROM p JOIN b ON {MEET} GROUP BY b.id")
def sjoin_broadcast(spark: SparkSession, d: str) -> DataFrame:
    f = customer_points(spark, d).spatial_join(supplier_boxes(spark, d), "right.{id as bid}", broadcast=True)
    return f.aggregate_by_group("bid", agg.count().alias("n")).df


@query(f"WITH a AS ({SBOX}), b AS ({SBOX}) SELECT a.id AS aid, b.id AS bid FROM a JOIN b ON {OVER}")
def sjoin_box_box(spark: SparkSession, d: str) -> DataFrame:
    b = supplier_boxes(spark, d)
    return b.spatial_join(b, "left.{id as aid}, right.{id as bid}").df


@query(f"WITH a AS ({SBOX}), b AS ({SBOX}) SELECT a.id AS aid, b.id AS bid FROM a JOIN b ON a.x0 <= b.x0 AND b.x1 <= a.x1 AND a.y0 <= b.y0 AND b.y1 <= a.y1")
def sjoin_contains(spark: SparkSession, d: str) -> DataFrame:
    b = supplier_boxes(spark, d)
    return b.spatial_join(b, "left.{id as aid}, right.{id as bid}", "contains").df


@query(f"WITH a AS ({PTS}), b AS ({SBOX}) SELECT a.id AS aid, b.id AS bid FROM a JOIN b ON sqrt(greatest(b.x0 - a.x, a.x - b.x1, 0) ** 2 + greatest(b.y0 - a.y, a.y - b.y1, 0) ** 2) <= 1.5")
def sjoin_within_distance(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).spatial_join(supplier_boxes(spark, d), "left.{id as aid}, right.{id as bid}", "within_distance", 1.5).df


@query(f"WITH p AS ({PTS}), b AS ({SBOX}) SELECT p.id, p.x FROM p WHERE EXISTS (SELECT 1 FROM b WHERE {MEET})")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).spatial_semi_join(supplier_boxes(spark, d), key="id").project("id, x").df


@query(f"WITH p AS ({PTS}), b AS ({SBOX}) SELECT p.id, p.x FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE {MEET})")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return customer_points(spark, d).spatial_semi_join(supplier_boxes(spark, d), negated=True).project("id, x").df


#: Each district's area that any service area covers, by cutting it at all their edges.
COVERED = f"""WITH a AS ({NBOX}), b AS ({SBOX}),
o AS (SELECT a.id, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1, greatest(a.y0, b.y0) AS y0, least(a.y1, b.y1) AS y1 FROM a JOIN b ON {OVER}),
xs AS (SELECT id, x, lead(x) OVER (PARTITION BY id ORDER BY x) AS x2 FROM (SELECT id, x0 AS x FROM o UNION SELECT id, x1 FROM o)),
ys AS (SELECT id, y, lead(y) OVER (PARTITION BY id ORDER BY y) AS y2 FROM (SELECT id, y0 AS y FROM o UNION SELECT id, y1 FROM o)),
c AS (SELECT xs.id, sum((x2 - x) * (y2 - y)) AS area FROM xs JOIN ys ON xs.id = ys.id AND x2 > x AND y2 > y WHERE EXISTS (SELECT 1 FROM o WHERE o.id = xs.id AND o.x0 <= x AND x2 <= o.x1 AND o.y0 <= y AND y2 <= o.y1) GROUP BY xs.id)"""


@query(f"{COVERED} SELECT a.id, round(400 - coalesce(c.area, 0), 4) AS area FROM a LEFT JOIN c ON a.id = c.id WHERE 400 - coalesce(c.area, 0) > 0.000001")
def difference_join(spark: SparkSession, d: str) -> DataFrame:
    """What no service area covers of each district; several overlap."""
    f = nation_boxes(spark, d).difference_join(supplier_boxes(spark, d))
    return f.df.select("id", F.round(st.BY_NAME["ST_Area"](f._wkb()), 4).alias("area"))


@query(f"{COVERED} SELECT o.id, round(coalesce(max(c.area), 0), 4) AS area FROM o LEFT JOIN c ON o.id = c.id GROUP BY o.id")
def arc_clip(spark: SparkSession, d: str) -> DataFrame:
    """What service areas cover of each district that meets any."""
    f = nation_boxes(spark, d).arc_clip(supplier_boxes(spark, d))
    return f.df.select("id", F.round(st.BY_NAME["ST_Area"](f._wkb()), 4).alias("area"))


@query()
def arc_buffer(spark: SparkSession, d: str) -> DataFrame:
    f = supplier_boxes(spark, d).arc_buffer(1.0, dissolve=True)
    return f.df.select("FID", F.round(st.BY_NAME["ST_Area"](F.col("the_geom")), 4).alias("area"))


@query(f"""WITH RECURSIVE b AS ({SBOX}), near AS (SELECT a.id AS a, b.id AS b FROM ({SBOX}) a JOIN b ON sqrt(greatest(b.x0 - a.x1, a.x0 - b.x1, 0) ** 2 + greatest(b.y0 - a.y1, a.y0 - b.y1, 0) ** 2) <= 0.002),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)
SELECT count(DISTINCT m) AS sets, (SELECT count(*) FROM b) AS boxes FROM (SELECT a, min(b) AS m FROM reach GROUP BY a)""")
def arc_buffer_sets(spark: SparkSession, d: str) -> DataFrame:
    """Connected sets of narrow buffers."""
    b = supplier_boxes(spark, d)
    sets = b.arc_buffer(0.001, dissolve=True).df.agg(F.count_distinct("FID").alias("sets")).withColumn("k", F.lit(1))
    return sets.join(b.df.agg(F.count(F.lit(1)).alias("boxes")).withColumn("k", F.lit(1)), "k").drop("k")


# -- data sets


def catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, scratch(spark, "catalog"))


@query(f"{PTS} UNION ALL SELECT s_suppkey, s_acctbal / 100.0, 0.0 FROM supplier")
def catalog_store(spark: SparkSession, d: str) -> DataFrame:
    """Stored, appended to and read back."""
    c, p = catalog(spark), customer_points(spark, d)
    c.store(p, "poi/places")
    more = table(spark, d, "supplier").df.selectExpr("s_suppkey AS id", "s_acctbal / 100D AS x", "0D AS y")
    c.store(GeoFrame(more).to_point("x", "y"), "poi/places", append=True)
    return c.get("poi/places").read().df.select("id", "x", "y")


@query(f"SELECT count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, 'FILE' AS type, true AS has_bytes, false AS indexed FROM ({PTS})")
def catalog_info(spark: SparkSession, d: str) -> DataFrame:
    """Count, bounds, type and size of a stored set."""
    c = catalog(spark)
    ds = c.store(customer_points(spark, d), "places")
    b = ds.bounds
    return spark.createDataFrame([(ds.count, *b, ds.info.type, ds.length() > 0, ds.has_spatial_index)], "n long, xmin double, xmax double, ymin double, ymax double, type string, has_bytes boolean, indexed boolean")


@query("SELECT * FROM (VALUES ('a/b/three', 5, true), ('a/one', 5, true), ('two', 5, false)) t(id, n, in_a)")
def catalog_list(spark: SparkSession, d: str) -> DataFrame:
    """All sets, those of a folder, one that is not there, and a folder that goes."""
    c, r = catalog(spark), table(spark, d, "region")
    for id in ("two", "a/one", "a/b/three", "gone/four"):
        c.store(r, id)
    if c.get_or_none("nothing") is not None or c.delete_dir("gone") != ["gone/four"]:
        raise AssertionError("a set that is not there was found")
    in_a = {x.id for x in c.in_dir("a", True)}
    return spark.createDataFrame([(x.id, x.count, x.id in in_a) for x in c.all()], "id string, n long, in_a boolean")


@query(f"SELECT id, x, y FROM ({PTS}) WHERE x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 70")
def catalog_query(spark: SparkSession, d: str) -> DataFrame:
    """Rows in a range; the bounds go to the scan."""
    c = catalog(spark)
    return c.store(customer_points(spark, d), "places").query((10.0, 20.0, 40.0, 70.0)).df.select("id", "x", "y")


TILES = [a + b for a in "0123" for b in "0123"]


@query("SELECT id FROM (SELECT event_id AS id, ((user_id * 7919) % 36000) / 100.0 - 180 AS x, ((event_id * 104729) % 17000) / 100.0 - 85 AS y FROM events) WHERE x BETWEEN -90 AND 45 AND y BETWEEN -20 AND 50")
def catalog_cluster(spark: SparkSession, d: str) -> DataFrame:
    """A clustered copy and a range query that reads the tiles it meets."""
    c = catalog(spark)
    ds = c.store(event_places(spark, d), "places").cluster("tiles", TILES)
    return ds.query((-90.0, -20.0, 45.0, 50.0)).df.select("id")


@query("SELECT count(*) AS owned, count(*) AS n, true AS more_in_all, true AS known FROM events")
def catalog_cluster_info(spark: SparkSession, d: str) -> DataFrame:
    """Each row is owned once; rows on edges lie in several tiles."""
    c = catalog(spark)
    ds = c.store(event_places(spark, d), "places").cluster("tiles", keys=TILES)
    i = ds.spatial_index_info()
    return spark.createDataFrame([(i["owned"], ds.read().count(), i["total"] >= i["owned"], set(ds.quad_keys()) <= set(TILES))], "owned long, n long, more_in_all boolean, known boolean")


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
def catalog_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each key."""
    ds = catalog(spark).store_by_key(table(spark, d, "customer"), "by", "c_nationkey")
    return ds.read().df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(f"WITH p AS ({PTS} ), b AS ({SBOX}) SELECT b.id AS bid, count(*) AS n FROM b JOIN p ON {MEET} GROUP BY b.id")
def catalog_join(spark: SparkSession, d: str) -> DataFrame:
    """A join with a clustered set, of which only the tiles that the left side meets are read."""
    c = catalog(spark)
    p = customer_points(spark, d)
    ds = c.store(GeoFrame(p.df, "the_geom", "EPSG:4326"), "places").cluster("tiles", TILES)
    f = supplier_boxes(spark, d).spatial_join(ds, "left.{id as bid}")
    return f.aggregate_by_group("bid", agg.count().alias("n")).df


# -- operators and functions that the queries above leave out


@query("SELECT true AS fair, true AS known, true AS again FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)")
def sample_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A sample has about its share of the rows, none twice, and the same ones for the same seed."""
    o = table(spark, d, "orders")
    s, t = (o.sample(0.1, 42).df.select("o_orderkey") for _ in range(2))
    n, k = o.count(), s.count()
    same = s.intersect(t).count() == k and s.distinct().count() == k
    return spark.createDataFrame([(abs(k - n / 10) <= 5 * (n * 0.09) ** 0.5, s.subtract(o.df.select("o_orderkey")).count() == 0, same)], "fair boolean, known boolean, again boolean")


@query("SELECT n_regionkey, round(sum(c) / 2, 4) AS area FROM (" + """WITH b AS (SELECT n_regionkey, (n_nationkey % 5) * 20.0::DOUBLE AS x0, floor(n_nationkey / 5.0) * 20.0::DOUBLE AS y0 FROM nation),
pt AS (SELECT DISTINCT n_regionkey, x0 + dx AS x, y0 + dy AS y FROM b, (VALUES (0, 0), (0, 20), (20, 0), (20, 20)) v(dx, dy))
SELECT p.n_regionkey, p.x * q.y - q.x * p.y AS c FROM pt p JOIN pt q ON p.n_regionkey = q.n_regionkey AND (p.x <> q.x OR p.y <> q.y)
WHERE NOT EXISTS (SELECT 1 FROM pt r WHERE r.n_regionkey = p.n_regionkey AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) > 0 AND (r.x - q.x) * (p.x - q.x) + (r.y - q.y) * (p.y - q.y) > 0)))""" + ") GROUP BY n_regionkey")
def convex_hull_area(spark: SparkSession, d: str) -> DataFrame:
    """The hull of each region's boxes, by its area."""
    n = table(spark, d, "nation").df.select("n_nationkey", "n_regionkey")
    b = nation_boxes(spark, d).df
    f = GeoFrame(b.join(n, b.id == n.n_nationkey), "the_geom").aggregate_by_group("n_regionkey", agg.convex_hull("the_geom"))
    return f.df.select("n_regionkey", F.round(st.BY_NAME["ST_Area"]("convex_hull"), 4).alias("area"))


@query(f"SELECT id, true AS within, round((x1 - x0) * (y1 - y0), 6) AS hull, x0, y1 FROM ({SBOX})")
def st_interior_hull_envelope(spark: SparkSession, d: str) -> DataFrame:
    """A point within, the hull's area and the envelope of boxes as WKB."""
    ship(spark)
    g = st.wkb(F.col("the_geom"), st.ENVELOPE)
    b = supplier_boxes(spark, d).spread().df.withColumn("g", g)
    e = st.BY_NAME["ST_AsEnvelope"]("g")
    b = b.select("id", st.BY_NAME["ST_Contains"](F.col("g"), st.BY_NAME["ST_InteriorPoint"]("g")).alias("within"), F.round(st.BY_NAME["ST_Area"](st.BY_NAME["ST_ConvexHull"]("g")), 6).alias("hull"), e.alias("e"))
    return b.select("id", "within", "hull", F.col("e.xmin").alias("x0"), F.col("e.ymax").alias("y1"))


@query(f"SELECT id, round(greatest(least(x1, 60) - greatest(x0, 40), 0) * greatest(least(y1, 60) - greatest(y0, 40), 0), 6) AS area FROM ({SBOX}) WHERE x0 <= 60 AND x1 >= 40 AND y0 <= 60 AND y1 >= 40")
def frame_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Two geometry columns of a row, after a filter by WKB."""
    from .functions import kernel as k

    shape = k.to_wkb(k.box(40.0, 40.0, 60.0, 60.0))
    f = supplier_boxes(spark, d).spread().filter_spatial(shape)
    f = GeoFrame(f.df.withColumn("fixed", F.lit(bytearray(shape))), "the_geom").intersection("fixed", "common")
    return f.df.select("id", F.round(st.BY_NAME["ST_Area"]("common"), 6).alias("area"))


@query(f"SELECT id, x, y FROM ({PTS}) WHERE x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 20")
def filter_by_frame(spark: SparkSession, d: str) -> DataFrame:
    """By another frame's first geometry; a frame without one matches nothing."""
    key = nation_boxes(spark, d).filter_sql("id = 0")
    p = customer_points(spark, d)
    none = p.filter_spatial(key.filter_sql("id < 0"))
    return GeoFrame.union([p.filter_spatial(key), none]).df.select("id", "x", "y")


@query("SELECT event_id AS id, round(4 * 111319.490793::DOUBLE * 111319.490793::DOUBLE / 1e6, 1) AS wide FROM events WHERE abs(((event_id * 104729) % 17000) / 100.0 - 85.0) < 0.000001")
def transform_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Boxes two degrees wide, to metres; the width is the same at any latitude."""
    f = event_places(spark, d).filter_sql("abs(y) < 0.000001")
    box = f.df.selectExpr("id", "x AS x0", "x + 2D AS x1")
    e = GeoFrame(box.selectExpr("*", "0D AS y0", "1D AS y1")).to_box("x0", "y0", "x1", "y1")
    w = GeoFrame(e.df.withColumn("the_geom", st.wkb(F.col("the_geom"), st.ENVELOPE)), "the_geom", "EPSG:4326").transform_crs("EPSG:3857")
    b = st.envelope(F.col("the_geom"), st._binary)
    return w.df.select("id", b.alias("e")).select("id", F.round(F.expr("(e.xmax - e.xmin) * (e.xmax - e.xmin)") / 1e6, 1).alias("wide"))


@query("SELECT count(*) AS n, true AS few, true AS ordered FROM events")
def partition_by_quadkey(spark: SparkSession, d: str) -> DataFrame:
    """Keys estimated from a sample; a key lies in one partition, and partitions follow the keys' order."""
    f = event_places(spark, d).partition_by_quad_key(ratio=0.5, cluster_bytes=64.0 * 1000, count=6)
    own = f.df.select("id", "quad_key", F.spark_partition_id().alias("p"))
    ends = own.filter(F.col("quad_key") != quadkey.OUTLIER).groupBy("p").agg(F.min("quad_key").alias("lo"), F.max("quad_key").alias("hi")).orderBy("p").collect()
    ordered = all(a.hi < b.lo for a, b in zip(ends, ends[1:]))
    return own.agg(F.count_distinct("id").alias("n"), (F.count_distinct("p") <= 6).alias("few")).withColumn("ordered", F.lit(ordered))


@query("SELECT o_custkey AS cust, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def map_to_pair(spark: SparkSession, d: str) -> DataFrame:
    """Rows as key and value, grouped by the key."""
    f = table(spark, d, "orders").map_to_pair("o_custkey, o_orderstatus")
    return f.df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value.o_totalprice"), 2).alias("total")).select(F.col("key.o_custkey").alias("cust"), F.col("key.o_orderstatus").alias("status"), "n", "total")


@query("SELECT c_mktsegment, 1 AS parts, count(*) AS n FROM customer GROUP BY c_mktsegment")
def partition_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Each key lies in one partition."""
    f = table(spark, d, "customer").partition_by_key("c_mktsegment", 7)
    own = f.df.select("c_mktsegment", F.spark_partition_id().alias("p"))
    return own.groupBy("c_mktsegment").agg(F.count_distinct("p").alias("parts"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, string_agg(n_name, '-' ORDER BY n_name) AS names, (max(n_nationkey % 5) - min(n_nationkey % 5) + 1) * 20.0::DOUBLE * (floor(max(n_nationkey) / 5.0) - floor(min(n_nationkey) / 5.0) + 1) * 20 AS box FROM nation GROUP BY n_regionkey")
def sql_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """envelope and concat_str in SQL."""
    ship(spark)
    st.register(spark)
    n, b = table(spark, d, "nation").df, nation_boxes(spark, d).df
    rows = b.join(n, b.id == n.n_nationkey).select("n_regionkey", "n_name", st.wkb(F.col("the_geom"), st.ENVELOPE).alias("g"))
    return spark.sql("SELECT n_regionkey, concat_str(n_name, '-') AS names, ST_Area(envelope(g)) AS box FROM {rows} GROUP BY n_regionkey", rows=rows)


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 400.0::DOUBLE END AS area, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE (n_nationkey % 5) * 20.0::DOUBLE + 10 END AS cx, n_nationkey % 3 <> 0 AS met FROM nation")
def null_on_error(spark: SparkSession, d: str) -> DataFrame:
    """Geometries that can't be read give NULL and meet nothing; nothing stops."""
    ship(spark)
    b = nation_boxes(spark, d).df
    g = F.when(F.col("id") % 3 == 0, F.lit(bytearray(b"\0"))).otherwise(st.wkb(F.col("the_geom"), st.ENVELOPE))
    f = GeoFrame(b.select("id", g.alias("g")), "g").centroid(output="c")
    e = st.envelope(F.col("c"), st._binary)
    return f.df.select("id", st.BY_NAME["ST_Area"]("g").alias("area"), e.alias("e"), F.coalesce(st.BY_NAME["ST_Intersects"](F.col("g"), F.col("g")), F.lit(False)).alias("met")).select("id", "area", F.col("e.xmin").alias("cx"), "met")


@query("SELECT o_orderkey, round(coalesce((o_totalprice + o_custkey) / 2, 0), 4) AS mean, round(o_totalprice + o_custkey, 4) AS total FROM orders")
def sql_array_functions(spark: SparkSession, d: str) -> DataFrame:
    st.register(spark)
    rows = table(spark, d, "orders").df.selectExpr("o_orderkey", "array(o_totalprice, cast(o_custkey AS DOUBLE)) AS a")
    return spark.sql("SELECT o_orderkey, round(ST_ArrayAvg(a), 4) AS mean, round(ST_ArraySum(a), 4) AS total FROM {rows}", rows=rows)


# -- workloads


@query(f"WITH p AS ({PTS}), b AS ({NBOX}), s AS ({SBOX}), far AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {MEET})) SELECT b.id AS district, count(*) AS n, round(sum(p.x), 4) AS xs FROM far p JOIN b ON {MEET} GROUP BY b.id")
def far_from_service(spark: SparkSession, d: str) -> DataFrame:
    """Places that no service area covers, by district."""
    far = customer_points(spark, d).spatial_semi_join(supplier_boxes(spark, d), negated=True, key="id")
    f = far.spatial_join(nation_boxes(spark, d), "left.x, right.{id as district}")
    return f.aggregate_by_group("district", agg.count().alias("n"), agg.sum_("x").alias("xs")).update_sql("xs", "round(xs, 4)").df


@query("SELECT l_suppkey AS supp, " + ", ".join(f"round(coalesce(sum(l_quantity) FILTER (month(l_shipdate) = {m}), 0), 2) AS month{m:02d}" for m in range(1, 13)) + " FROM lineitem GROUP BY l_suppkey")
def monthly_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage by month as twelve columns, gaps filled."""
    f = table(spark, d, "lineitem").update_sql("m", "month(l_shipdate)").define_column("month:string", "String.format('month%02d', m)")
    f = f.aggregate_by_group("l_suppkey, month", agg.sum_("l_quantity").alias("usage"))
    names = [f"month{m:02d}" for m in range(1, 13)]
    f = f.pivot("l_suppkey", "month", agg.sum_("usage"), names).fill_na(names, 0.0)
    return f.df.select(F.col("l_suppkey").alias("supp"), *[F.round(n, 2).alias(n) for n in names])
