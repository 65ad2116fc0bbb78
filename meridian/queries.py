"""Registered queries over the test tables, and the SQL that must give the same rows.

Workload queries are PostgreSQL text that the engine rewrites and runs; the others call operators. Fixtures are derived
from the tables by arithmetic that every engine does alike: points from customers and suppliers, territories from
nations, rectangles and SQL pairs from parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import geo, text
from meridian.operators import compare, report, score, sequences, spatial, split
from meridian.plans import execute
from meridian.plans.dialect import to_spark
from meridian.sources import files

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL of the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- workload in PostgreSQL text

WORKLOAD = {
    "tier_easy": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 OR c_custkey IN (1, 2, 3)",
    "tier_medium": "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(c.c_acctbal)::numeric, 2)::double precision AS total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA' GROUP BY n.n_name ORDER BY n DESC, n.n_name LIMIT 10",
    "tier_hard": "SELECT r.r_name, p.p_brand, COUNT(DISTINCT o.o_orderkey) AS orders, SUM(l.l_quantity) AS quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R' GROUP BY r.r_name, p.p_brand HAVING SUM(l.l_quantity) > 100",
    "tier_very_hard": """
        WITH spent AS (
          SELECT c.c_custkey, n.n_name, SUM(o.o_totalprice) AS total, COUNT(*) AS orders
          FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY c.c_custkey, n.n_name
        ), ranked AS (SELECT s.*, RANK() OVER (PARTITION BY n_name ORDER BY orders DESC, c_custkey) AS place FROM spent s)
        SELECT n_name, c_custkey, orders, CASE WHEN orders > 15 THEN 'many' WHEN orders > 8 THEN 'some' ELSE 'few' END AS kind FROM ranked WHERE place <= 3
        UNION ALL
        SELECT n.n_name, -1 AS c_custkey, COUNT(s.s_suppkey) AS orders, 'suppliers' AS kind FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""",
    "hierarchy_rollup": "SELECT r.r_name, n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP(r.r_name, n.n_name)",
    "cube_counts": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
    "equi_join": "SELECT s.s_suppkey, n.n_name FROM supplier s INNER JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "outer_join": "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "full_join": "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a FULL JOIN (SELECT s_suppkey, s_suppkey * 20 AS k FROM supplier) b ON a.c_custkey = b.k WHERE a.c_custkey IS NULL OR b.s_suppkey IS NOT NULL",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "having_filter": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15 AND MAX(o_totalprice) > 100000",
    "aggregates": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS quantity, ROUND(AVG(l_discount)::numeric, 4)::double precision AS discount, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "filtered_aggregates": "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::bigint AS open FROM orders GROUP BY o_orderpriority",
    "rank_window": "SELECT o_orderkey, RANK() OVER (ORDER BY o_totalprice DESC) AS place, DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS own FROM orders",
    "running_window": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "moving_window": "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders",
    "topk": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "top_per_group": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) x WHERE k <= 2",
    "union_cte": "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0), b AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 10) SELECT k FROM a UNION SELECT k FROM b",
    "intersect_all_kinds": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except_rows": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 20",
    "case_when": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS kind FROM customer",
    "distinct_rows": "SELECT DISTINCT p_brand, p_size FROM part",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "recursive_cte": "WITH RECURSIVE k(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM k WHERE n < 20) SELECT n, n * n AS square FROM k",
    "date_filter": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'",
    "like_filter": "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%brass%' OR p_name LIKE '%a%e%'",
    "numeric_round": "SELECT l_orderkey, l_linenumber, ROUND((l_extendedprice * (1 - l_discount))::numeric, 1)::double precision AS net FROM lineitem WHERE l_linenumber = 1",
    "integer_division": "SELECT p_partkey, 7 / 2 AS three, p_size::int / 4::int AS quarter FROM part",
    "null_order": "SELECT k, ROW_NUMBER() OVER (ORDER BY v DESC, k) AS down, ROW_NUMBER() OVER (ORDER BY v, k) AS up FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS v FROM nation) x",
    "cross_join_small": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey",
    "using_join": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, COUNT(*) AS b FROM supplier GROUP BY s_nationkey) y USING (k)",
}
#: Where DuckDB reads PostgreSQL text in another way.
ORACLE_TEXT = {k: v.replace("::numeric", "::decimal(38,10)") for k, v in WORKLOAD.items() if "::numeric" in v} | {"integer_division": WORKLOAD["integer_division"].replace(" / ", " // "), "null_order": WORKLOAD["null_order"].replace("v DESC, k", "v DESC NULLS FIRST, k").replace("ORDER BY v, k", "ORDER BY v NULLS LAST, k")}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    files.register_tables(spark, sf_dir, TABLES)
    return spark.sql(to_spark(sql))


def _workload(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


for _name, _sql in WORKLOAD.items():
    QUERIES[_name] = _workload(_sql)
    ORACLES[_name] = ORACLE_TEXT.get(_name, _sql)

# -- fixtures


def place_of(key: Column) -> tuple[Column, Column]:
    return (key * 7919 % 10007).cast("double") * 5.0 / 10007.0, (key * 104729 % 10009).cast("double") * 5.0 / 10009.0


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = place_of(F.col("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = place_of(F.col("s_suppkey") * 31)
    return t(spark, sf_dir, "supplier").select("s_suppkey", x.alias("sx"), y.alias("sy"))


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    return t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", geo.st_makeenvelope(x, y, x + 1.0, y + 1.0, geo.SRID).alias("geometry"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = place_of(F.col("p_partkey"))
    side = F.col("p_size").cast("double") / 250.0
    return t(spark, sf_dir, "part").select("p_partkey", "p_size", x.alias("xmin"), y.alias("ymin"), (x + side).alias("xmax"), (y + side).alias("ymax"))


def box_of(g: str) -> dict[str, Column]:
    return {"xmin": geo.st_xmin(F.col(g)), "ymin": geo.st_ymin(F.col(g)), "xmax": geo.st_xmax(F.col(g)), "ymax": geo.st_ymax(F.col(g))}


def columns_box(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in ("xmin", "ymin", "xmax", "ymax")}


CUSTOMERS = "customers AS (SELECT c_custkey, CAST(c_custkey * 7919 % 10007 AS DOUBLE) * 5.0::DOUBLE / 10007.0::DOUBLE AS x, CAST(c_custkey * 104729 % 10009 AS DOUBLE) * 5.0::DOUBLE / 10009.0::DOUBLE AS y FROM customer)"
SUPPLIERS = "suppliers AS (SELECT s_suppkey, CAST(s_suppkey * 31 * 7919 % 10007 AS DOUBLE) * 5.0::DOUBLE / 10007.0::DOUBLE AS sx, CAST(s_suppkey * 31 * 104729 % 10009 AS DOUBLE) * 5.0::DOUBLE / 10009.0::DOUBLE AS sy FROM supplier)"
TERRITORIES = "territories AS (SELECT n_nationkey, n_name, n_regionkey, CAST(n_nationkey % 5 AS DOUBLE) AS xmin, CAST(n_nationkey // 5 AS DOUBLE) AS ymin, CAST(n_nationkey % 5 AS DOUBLE) + 1.0::DOUBLE AS xmax, CAST(n_nationkey // 5 AS DOUBLE) + 1.0::DOUBLE AS ymax FROM nation)"
RECTANGLES = """rectangles AS (SELECT p_partkey, p_size, xmin, ymin, xmin + side AS xmax, ymin + side AS ymax FROM (SELECT p_partkey, p_size,
  CAST(p_partkey * 7919 % 10007 AS DOUBLE) * 5.0::DOUBLE / 10007.0::DOUBLE AS xmin, CAST(p_partkey * 104729 % 10009 AS DOUBLE) * 5.0::DOUBLE / 10009.0::DOUBLE AS ymin, CAST(p_size AS DOUBLE) / 250.0::DOUBLE AS side FROM part) z)"""
HAVERSINE = "2.0::DOUBLE * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(sy) - radians(y)) / 2), 2) + cos(radians(y)) * cos(radians(sy)) * pow(sin((radians(sx) - radians(x)) / 2), 2))))"
WITHIN = "x > xmin AND x < xmax AND y > ymin AND y < ymax"

# -- spatial joins and measures


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.join_inside(territories(spark, sf_dir), customers(spark, sf_dir), "geometry", F.col("x"), F.col("y"), cell=0.5)


@query(f"WITH {CUSTOMERS}, {TERRITORIES} SELECT n_name, count(*) AS facilities FROM territories JOIN customers ON {WITHIN} GROUP BY n_name")
def st_contains_join(spark, sf_dir):
    """Facilities in each territory."""
    return contained(spark, sf_dir).groupBy("n_name").agg(F.count(F.lit(1)).alias("facilities"))


@query(f"WITH {CUSTOMERS}, {TERRITORIES} SELECT r_name, count(*) AS facilities FROM territories JOIN customers ON {WITHIN} JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def hierarchy_of_places(spark, sf_dir):
    joined = contained(spark, sf_dir).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("facilities"))


@query(f"WITH {CUSTOMERS} SELECT c_custkey FROM customers WHERE x > 1 AND x < 3.5 AND y > 0.5 AND y < 2")
def st_within_filter(spark, sf_dir):
    area = geo.st_makeenvelope(F.lit(1.0), F.lit(0.5), F.lit(3.5), F.lit(2.0), geo.SRID)
    return customers(spark, sf_dir).where(geo.st_contains_point(area, geo.st_makepoint(F.col("x"), F.col("y"), geo.SRID))).select("c_custkey")


@query(f"WITH {CUSTOMERS}, {SUPPLIERS} SELECT c_custkey, s_suppkey, round({HAVERSINE}, 2) AS metres FROM customers, suppliers WHERE {HAVERSINE} <= 20000")
def st_dwithin_join(spark, sf_dir):
    pairs = spatial.join_within(customers(spark, sf_dir), suppliers(spark, sf_dir), (F.col("x"), F.col("y")), (F.col("sx"), F.col("sy")), 20_000.0, geodetic=True, name="d")
    return pairs.select("c_custkey", "s_suppkey", F.round("d", 2).alias("metres"))


@query(f"WITH {CUSTOMERS}, {SUPPLIERS}, r AS (SELECT c_custkey, s_suppkey, sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) AS d FROM customers, suppliers), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS INTEGER) AS rank FROM r) SELECT c_custkey, rank, s_suppkey, round(d, 6) AS distance FROM k WHERE rank <= 2")
def st_distance_nearest(spark, sf_dir):
    found = spatial.nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", (F.col("x"), F.col("y")), (F.col("sx"), F.col("sy")), 2, ["s_suppkey"], 0.3, name="d")
    return found.select("c_custkey", F.col("rank").cast("int").alias("rank"), "s_suppkey", F.round("d", 6).alias("distance"))


_BOXES = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.join_boxes(territories(spark, sf_dir), rectangles(spark, sf_dir), box_of("geometry"), columns_box(), cell=0.25)


@query(f"WITH {TERRITORIES}, {RECTANGLES} SELECT n_nationkey, p_partkey FROM territories a JOIN rectangles b ON {_BOXES}")
def st_intersects_rect(spark, sf_dir):
    return overlapping(spark, sf_dir).select("n_nationkey", "p_partkey")


@query(f"WITH {RECTANGLES} SELECT a.p_partkey AS a, b.p_partkey AS b FROM rectangles a JOIN rectangles b ON {_BOXES} WHERE a.p_partkey < b.p_partkey")
def st_intersects_self(spark, sf_dir):
    r = rectangles(spark, sf_dir)
    a, b = (d.select(*(F.col(c).alias(f"{p}_{c}") for c in r.columns)) for d, p in ((r, "a"), (r, "b")))
    met = spatial.join_boxes(a, b, columns_box("a_"), columns_box("b_"), F.col("a_p_partkey") < F.col("b_p_partkey"), cell=0.1)
    return met.select(F.col("a_p_partkey").alias("a"), F.col("b_p_partkey").alias("b"))


@query(f"WITH {TERRITORIES}, {RECTANGLES} SELECT n_nationkey, round(sum(greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))), 4) AS area FROM territories a JOIN rectangles b ON {_BOXES} GROUP BY n_nationkey")
def st_intersection_area(spark, sf_dir):
    other = geo.st_makeenvelope(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), geo.SRID)
    met = overlapping(spark, sf_dir).withColumn("shared", geo.st_intersection(F.col("geometry"), other))
    return met.groupBy("n_nationkey").agg(F.round(F.sum(geo.st_area(F.col("shared"))), 4).alias("area"))


@query(f"WITH {TERRITORIES} SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM territories a JOIN territories b ON {_BOXES} AND a.n_nationkey < b.n_nationkey")
def st_touches_rect(spark, sf_dir):
    """Neighbouring territories share edges or corners only."""
    a = territories(spark, sf_dir).select(F.col("n_nationkey").alias("a"), F.col("geometry").alias("ga"))
    b = territories(spark, sf_dir).select(F.col("n_nationkey").alias("b"), F.col("geometry").alias("gb"))
    return spatial.join_boxes(a, b, box_of("ga"), box_of("gb"), F.col("a") < F.col("b")).where(geo.st_touches(F.col("ga"), F.col("gb"))).select("a", "b")


@query(f"WITH {CUSTOMERS}, {SUPPLIERS} SELECT s_suppkey, count(*) AS n FROM suppliers JOIN customers ON sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) <= 0.2 GROUP BY s_suppkey")
def st_buffer_contains(spark, sf_dir):
    """Points in a point's buffer are those within its radius: the buffer stays a centre and a radius."""
    pairs = spatial.join_within(suppliers(spark, sf_dir), customers(spark, sf_dir), (F.col("sx"), F.col("sy")), (F.col("x"), F.col("y")), 0.2)
    return pairs.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CUSTOMERS}, {SUPPLIERS}, s AS (SELECT (2 * k + 1) * pi() / {geo.shapes.SIDES} AS angle FROM range({geo.shapes.SIDES}) r(k)),
  near AS (SELECT s_suppkey, sx, sy, c_custkey, x, y FROM suppliers JOIN customers ON sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) < 0.11)
  SELECT s_suppkey, c_custkey FROM near JOIN s ON true GROUP BY s_suppkey, c_custkey HAVING max((x - sx) * cos(angle) + (y - sy) * sin(angle)) < 0.1 * cos(pi() / {geo.shapes.SIDES})""")
def st_buffer_polygon(spark, sf_dir):
    """Points inside the polygon that ST_Buffer makes: a side's normal says how far out it lies."""
    areas = suppliers(spark, sf_dir).withColumn("area", geo.st_buffer(geo.st_makepoint(F.col("sx"), F.col("sy")), F.lit(0.1)))
    met = spatial.join_inside(areas, customers(spark, sf_dir), "area", F.col("x"), F.col("y"), cell=0.2)
    return met.select("s_suppkey", "c_custkey")


@query(f"WITH {CUSTOMERS}, d AS (SELECT c_custkey, greatest(1.0 - x, 0, x - 2.5) AS dx, greatest(1.5 - y, 0, y - 3.0) AS dy FROM customers) SELECT c_custkey, round(sqrt(dx * dx + dy * dy), 6) AS distance, sqrt(dx * dx + dy * dy) <= 0.3 AS near FROM d")
def st_dwithin_area(spark, sf_dir):
    """ST_Distance and ST_DWithin of points and an area."""
    area, place = geo.st_makeenvelope(*map(F.lit, (1.0, 1.5, 2.5, 3.0))), geo.st_makepoint(F.col("x"), F.col("y"))
    return customers(spark, sf_dir).select("c_custkey", F.round(geo.st_distance(place, area), 6).alias("distance"), geo.st_dwithin(place, area, F.lit(0.3)).alias("near"))


@query(f"WITH {RECTANGLES} SELECT p_partkey, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * ((xmax - xmin) + (ymax - ymin)), 6) AS perimeter, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy FROM rectangles")
def st_measures(spark, sf_dir):
    """ST_Area, ST_Boundary with ST_Length, and ST_Centroid."""
    g = geo.st_makeenvelope(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    rows = rectangles(spark, sf_dir).withColumn("g", g).withColumn("centre", geo.st_centroid(F.col("g")))
    centre = F.col("centre")
    return rows.select("p_partkey", F.round(geo.st_area(F.col("g")), 6).alias("area"), F.round(geo.st_length(geo.st_boundary(F.col("g"))), 6).alias("perimeter"), F.round(geo.st_x(centre), 6).alias("cx"), F.round(geo.st_y(centre), 6).alias("cy"))


@query(f"WITH {CUSTOMERS}, {TERRITORIES} SELECT n_name, round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax FROM territories JOIN customers ON {WITHIN} GROUP BY n_name")
def st_extent(spark, sf_dir):
    place = {"xmin": "x", "xmax": "x", "ymin": "y", "ymax": "y"}
    boxes = spatial.extent(contained(spark, sf_dir), ["n_name"], lambda side: F.col(place[side]))
    return boxes.select("n_name", *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query(f"WITH {RECTANGLES} SELECT p_partkey, round(xmin + 1, 6) AS xmin, round(ymin - 1, 6) AS ymin, round(xmax + 1, 6) AS xmax, round(ymax - 1, 6) AS ymax FROM rectangles")
def st_translate_envelope(spark, sf_dir):
    g = geo.st_envelope(geo.st_translate(geo.st_makeenvelope(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))), F.lit(1.0), F.lit(-1.0)))
    rows = rectangles(spark, sf_dir).select("p_partkey", g.alias("g"))
    return rows.select("p_partkey", *(F.round(c, 6).alias(n) for n, c in box_of("g").items()))


@query(f"WITH {TERRITORIES} SELECT n_regionkey, round(CAST(count(*) AS DOUBLE), 6) AS area FROM territories GROUP BY n_regionkey")
def st_union_area(spark, sf_dir):
    merged = territories(spark, sf_dir).groupBy("n_regionkey").agg(F.collect_list("geometry").alias("all"))  # a territory's parts: bounded by the hierarchy
    parts = F.col("u")["rings"]
    area = F.aggregate(parts, F.lit(0.0), lambda a, r: a + geo.st_area(F.struct(F.lit("polygon").alias("kind"), F.array(r).alias("rings"))))
    return merged.select("n_regionkey", geo.union_of(F.col("all")).alias("u")).select("n_regionkey", F.round(area, 6).alias("area"))


@query(f"WITH {CUSTOMERS}, {TERRITORIES} SELECT n_name, count(*) AS n FROM territories JOIN customers ON {WITHIN} AND n_regionkey = 1 GROUP BY n_name")
def sql_st_contains(spark, sf_dir):
    """Spatial joins of PostgreSQL text, which the engine plans on grid cells."""
    return places_sql(spark, sf_dir, "SELECT t.n_name, COUNT(*) AS n FROM territories t JOIN places p ON ST_Contains(t.geometry, p.geometry) WHERE t.n_regionkey = 1 GROUP BY t.n_name")


def places_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over territories, places (customers), depots (suppliers) and plots (parts), each with a geometry."""
    geo.register(spark)
    territories(spark, sf_dir).createOrReplaceTempView("territories")
    customers(spark, sf_dir).select("c_custkey", geo.st_makepoint(F.col("x"), F.col("y"), geo.SRID).alias("geometry")).createOrReplaceTempView("places")
    suppliers(spark, sf_dir).select("s_suppkey", geo.st_makepoint(F.col("sx"), F.col("sy"), geo.SRID).alias("geometry")).createOrReplaceTempView("depots")
    plots = geo.st_makeenvelope(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), geo.SRID)
    rectangles(spark, sf_dir).select("p_partkey", plots.alias("geometry")).createOrReplaceTempView("plots")
    return spark.sql(to_spark(sql))


@query(f"WITH {TERRITORIES}, {RECTANGLES} SELECT n_nationkey, count(*) AS plots FROM territories a JOIN rectangles b ON {_BOXES} GROUP BY n_nationkey")
def sql_st_intersects(spark, sf_dir):
    return places_sql(spark, sf_dir, "SELECT t.n_nationkey, COUNT(*) AS plots FROM territories t, plots p WHERE ST_Intersects(p.geometry, t.geometry) GROUP BY t.n_nationkey")


@query(f"WITH {CUSTOMERS}, {SUPPLIERS} SELECT c_custkey, s_suppkey FROM customers, suppliers WHERE {HAVERSINE} <= 15000")
def sql_st_dwithin(spark, sf_dir):
    return places_sql(spark, sf_dir, "SELECT p.c_custkey, d.s_suppkey FROM places p JOIN depots d ON ST_DWithin(p.geometry::geography, d.geometry::geography, 15000)")


@query(f"WITH {TERRITORIES} SELECT a.n_name AS a, b.n_name AS b FROM territories a JOIN territories b ON {_BOXES} AND a.n_nationkey < b.n_nationkey")
def sql_st_touches(spark, sf_dir):
    return places_sql(spark, sf_dir, "SELECT a.n_name AS a, b.n_name AS b FROM territories a JOIN territories b ON a.n_nationkey < b.n_nationkey AND ST_Touches(a.geometry, b.geometry)")


@query(f"WITH {CUSTOMERS}, {TERRITORIES}, {SUPPLIERS} SELECT t.n_name, count(*) AS n FROM territories t JOIN customers ON {WITHIN} JOIN suppliers ON sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) <= 0.05 GROUP BY t.n_name")
def sql_st_within_chain(spark, sf_dir):
    """Two spatial joins that share a relation."""
    sql = "WITH near AS (SELECT * FROM places p JOIN territories t ON ST_Within(p.geometry, t.geometry)) SELECT n.n_name, COUNT(*) AS n FROM (SELECT q.n_name, q.c_custkey FROM near q) n JOIN places p ON p.c_custkey = n.c_custkey JOIN depots d ON ST_DWithin(p.geometry, d.geometry, 0.05) GROUP BY n.n_name"
    return places_sql(spark, sf_dir, sql.replace("SELECT * FROM places p", "SELECT p.c_custkey, t.* FROM places p"))


@query(f"WITH {CUSTOMERS} SELECT c_custkey, round(sqrt((x - 2) * (x - 2) + (y - 3) * (y - 3)), 6) AS d, abs(x - 2) <= 0.5 AND abs(y - 3) <= 0.5 AS near FROM customers")
def sql_st_distance(spark, sf_dir):
    geo.register(spark)
    customers(spark, sf_dir).createOrReplaceTempView("places_xy")
    sql = "SELECT c_custkey, ROUND(ST_Distance(ST_MakePoint(x, y), ST_MakePoint(2.0, 3.0)), 6) AS d, ST_Intersects(ST_MakePoint(x, y), ST_MakeEnvelope(1.5, 2.5, 2.5, 3.5)) AS near FROM places_xy"
    return spark.sql(to_spark(sql))


# -- texts of pairs

GOLD = "'SELECT p.p_name, COUNT(*) AS n FROM part p JOIN supplier s ON ST_Within(p.g, s.g) WHERE p.p_size = ' || p_size || ' AND ST_DWithin(p.g, s.g, 5) GROUP BY p.p_name ORDER BY n DESC LIMIT 5;'"
PREDICTED = f"""CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN lower({GOLD}) || ' '
  ELSE replace('SELECT   p.p_name, COUNT(*) AS n FROM part p JOIN supplier s ON ST_Within(p.g, s.g) WHERE p.p_size = ' || (p_size + p_partkey % 2) || ' AND ST_DWithin(p.g, s.g, 5) GROUP BY p.p_name',
    CASE WHEN p_partkey % 3 = 0 THEN 'ST_Within' ELSE 'ST_Nowhere' END, CASE WHEN p_partkey % 2 = 0 THEN 'ST_Intersects' ELSE 'ST_Contains' END) END"""
LEVEL = "CASE p_partkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'very hard' END"
PAIRS = f"pairs AS (SELECT p_partkey, {LEVEL} AS level, {GOLD} AS gold, {PREDICTED} AS predicted FROM part)"
NORM = "trim(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), ';+$', ''))"
TOKENS = "regexp_extract_all(" + NORM + ", '[a-z0-9_.*]+|<>|!=|>=|<=|[(),=<>!;]')"
CALLS = "list_transform(regexp_extract_all(" + NORM + ", 'st_[a-z0-9_]+\\s*\\('), lambda s: rtrim(s, ' ('))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").selectExpr("p_partkey", f"{LEVEL} AS level", f"{GOLD} AS gold", f"{PREDICTED} AS predicted")


def _overlap_sql(items: str, empty: str) -> str:
    return f"""u AS (SELECT p_partkey, 1 AS p, 0 AS g, unnest({items.format("predicted")}) AS item FROM pairs UNION ALL SELECT p_partkey, 0, 1, unnest({items.format("gold")}) FROM pairs),
      c AS (SELECT p_partkey, item, sum(p) AS p, sum(g) AS g FROM u GROUP BY p_partkey, item),
      s AS (SELECT p_partkey, CAST(sum(least(p, g)) AS INTEGER) AS tp, CAST(sum(p) AS INTEGER) AS n, CAST(sum(g) AS INTEGER) AS m FROM c GROUP BY p_partkey)
      SELECT p_partkey, tp, n - tp AS fp, m - tp AS fn, round(CASE WHEN n > 0 THEN tp / n ELSE {empty} END, 4) AS precision, round(CASE WHEN m > 0 THEN tp / m ELSE 0 END, 4) AS recall,
        round(CASE WHEN tp > 0 THEN 2 * (tp / n) * (tp / m) / (tp / n + tp / m) ELSE 0 END, 4) AS f1 FROM s"""


@query(f"WITH {PAIRS} SELECT p_partkey, {NORM.format('predicted')} = {NORM.format('gold')} AS string_exact FROM pairs")
def norm_exact(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", (text.normalized(F.col("predicted")) == text.normalized(F.col("gold"))).alias("string_exact"))


@query(f"WITH {PAIRS}, " + _overlap_sql(TOKENS, "0"))
def token_f1(spark, sf_dir):
    s = pairs(spark, sf_dir).select("p_partkey", text.token_scores(F.col("predicted"), F.col("gold")).alias("s"))
    return s.select("p_partkey", "s.tp", "s.fp", "s.fn", "s.precision", "s.recall", "s.f1")


@query(f"WITH {PAIRS}, " + _overlap_sql(CALLS, "0"))
def geo_f1(spark, sf_dir):
    s = pairs(spark, sf_dir).select("p_partkey", text.geo_scores(F.col("predicted"), F.col("gold")).alias("s"))
    return s.select("p_partkey", "s.tp", "s.fp", "s.fn", "s.precision", "s.recall", "s.f1")


@query(f"WITH {PAIRS} SELECT p_partkey, list_sort({CALLS.format('predicted')}) = list_sort({CALLS.format('gold')}) AS spatial_exact FROM pairs")
def geo_spatial_exact(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", (text.geo_calls(F.col("predicted")) == text.geo_calls(F.col("gold"))).alias("spatial_exact"))


@query(f"""WITH {PAIRS}, u AS (SELECT p_partkey, 1 AS p, 0 AS g, unnest({CALLS.format('predicted')}) AS function FROM pairs UNION ALL SELECT p_partkey, 0, 1, unnest({CALLS.format('gold')}) FROM pairs),
  c AS (SELECT p_partkey, function, sum(p) AS p, sum(g) AS g FROM u GROUP BY p_partkey, function), s AS (SELECT function, sum(least(p, g)) AS tp, sum(p - least(p, g)) AS fp, sum(g - least(p, g)) AS fn, sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) AS gold_queries FROM c GROUP BY function)
  SELECT 'base' AS model, function, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(gold_queries AS BIGINT) AS gold_queries, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM s""")
def geo_per_function(spark, sf_dir):
    calls = pairs(spark, sf_dir).select(F.lit("base").alias("model"), text.geo_calls(F.col("predicted")).alias("predicted_functions"), text.geo_calls(F.col("gold")).alias("gold_functions"))
    return report.per_function(calls)


ANSWER = f"CASE p_partkey % 5 WHEN 0 THEN 'Here: ```sql ' || {GOLD} || ' ``` done' WHEN 1 THEN '[tag] [other] The query is ' || {GOLD} || ' explained' WHEN 2 THEN 'no query' WHEN 3 THEN 'with t as (select ' || p_size || ') select * from t' END"
EXTRACTED = f"CASE p_partkey % 5 WHEN 0 THEN {GOLD} WHEN 1 THEN {GOLD} WHEN 3 THEN 'with t as (select ' || p_size || ') select * from t' ELSE '' END"


@query(f"SELECT p_partkey, {EXTRACTED} AS sql FROM part")
def extract_sql(spark, sf_dir):
    return t(spark, sf_dir, "part").selectExpr("p_partkey", f"{ANSWER} AS answer").select("p_partkey", text.extracted_sql(F.col("answer")).alias("sql"))


@query("SELECT p_partkey, 'Pergunta: ' || p_name || chr(10) || 'SQL:' AS prompt FROM part")
def prompts(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.prompt(F.col("p_name")).alias("prompt"))


_SPELLED = "CASE p_partkey % 9 WHEN 0 THEN 'Facíl' WHEN 1 THEN 'Facil' WHEN 2 THEN 'Medio' WHEN 3 THEN 'Dificil' WHEN 4 THEN 'Muito Dificil' WHEN 5 THEN 'Fácil' WHEN 6 THEN 'other' END"


@query(f"SELECT CASE level WHEN 'Facíl' THEN 'Fácil' WHEN 'Facil' THEN 'Fácil' WHEN 'Medio' THEN 'Médio' WHEN 'Dificil' THEN 'Difícil' WHEN 'Muito Dificil' THEN 'Muito Difícil' ELSE level END AS level, count(*) AS n FROM (SELECT {_SPELLED} AS level FROM part) x GROUP BY 1")
def level_remap(spark, sf_dir):
    return t(spark, sf_dir, "part").select(text.fixed_level(F.expr(_SPELLED)).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# -- splits

_STRATA = "o_orderpriority, o_orderstatus"


def _split_sql(rule: str, strata: str) -> str:
    return f"""WITH c AS (SELECT o_orderkey, {strata}, row_number() OVER (PARTITION BY {strata} ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k, greatest(1, {rule}(count(*) OVER (PARTITION BY {strata}) * 0.2::DOUBLE)) AS w FROM orders)
      SELECT o_orderkey, k <= w AS validation FROM c"""


@query(_split_sql("round_even", _STRATA).replace("round_even(count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) * 0.2::DOUBLE)", "round_even(count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) * 0.2::DOUBLE, 0)"))
def strat_split(spark, sf_dir):
    return split.stratified(t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 0.2).select("o_orderkey", "validation")


@query(_split_sql("floor", "o_orderpriority"))
def val_split(spark, sf_dir):
    return split.stratified(t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", 0.2, rule="floor").select("o_orderkey", "validation")


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def split_balance(spark, sf_dir):
    return split.balance(t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def seeded_shuffle(spark, sf_dir):
    from meridian.operators.ordering import numbered_rows

    return numbered_rows(t(spark, sf_dir, "orders").select("o_orderkey"), [split.hash_order(F.col("o_orderkey"), 7), F.col("o_orderkey")], "place").select("o_orderkey", "place")


# -- reports over made-up scores

_SCORES = "scores AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'base' ELSE 'finetuned' END AS model, l_linestatus AS level, CASE WHEN l_linenumber < 4 THEN 'd' || l_linenumber ELSE '' END AS division, l_discount AS v, l_quantity AS q FROM lineitem)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 'base' ELSE 'finetuned' END AS model", "l_linestatus AS level", "CASE WHEN l_linenumber < 4 THEN 'd' || l_linenumber ELSE '' END AS division", "l_discount AS v", "l_quantity AS q")
    part = F.struct(*(F.col("v").alias(x) for x in ("precision", "recall", "f1")), *(F.lit(1).alias(x) for x in ("tp", "fp", "fn")))
    flat = {c: F.col("v") for c in report.MEANS.values() if "." not in c}
    return rows.withColumns(flat | {"token": part, "geo": part, "execution_match": F.col("q") > 25, "gold_executable": F.col("q") > 10})


_MEANS_SQL = """count(*) AS n, round(avg(v), 4) AS token_f1, round(avg(v), 4) AS geospatial_precision, round(avg(v), 4) AS component_jaccard,
  round(avg(CASE WHEN q > 10 THEN CASE WHEN q > 25 THEN 1.0::DOUBLE ELSE 0 END END), 4) AS execution_accuracy, count(*) AS geo_tp, count(*) AS geo_fn"""


@query(f"""WITH {_SCORES} SELECT 'overall' AS scope, '' AS value, model, {_MEANS_SQL} FROM scores GROUP BY model UNION ALL SELECT 'level', level, model, {_MEANS_SQL} FROM scores GROUP BY level, model
  UNION ALL SELECT 'division', division, model, {_MEANS_SQL} FROM scores WHERE division <> '' GROUP BY division, model""")
def summary_grouping_sets(spark, sf_dir):
    return report.summary(scores(spark, sf_dir)).select("scope", "value", "model", "n", "token_f1", "geospatial_precision", "component_jaccard", "execution_accuracy", "geo_tp", "geo_fn")


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'base' ELSE 'finetuned' END AS model, round(avg(CASE WHEN l_quantity > 10 THEN CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END END), 4) AS execution_accuracy FROM lineitem GROUP BY 1")
def conditional_mean(spark, sf_dir):
    return report.summary(scores(spark, sf_dir)).where("scope = 'overall'").select("model", "execution_accuracy")


@query(f"""WITH {_SCORES}, m AS (SELECT 'overall' AS scope, '' AS value, model, round(avg(v), 4) AS x FROM scores GROUP BY model UNION ALL SELECT 'level', level, model, round(avg(v), 4) FROM scores GROUP BY level, model UNION ALL SELECT 'division', division, model, round(avg(v), 4) FROM scores WHERE division <> '' GROUP BY division, model)
  SELECT scope, value, round(max(CASE WHEN model = 'finetuned' THEN x END) - max(CASE WHEN model = 'base' THEN x END), 4) AS delta FROM m GROUP BY scope, value""")
def delta_pivot(spark, sf_dir):
    return report.deltas(report.summary(scores(spark, sf_dir)), "token_f1")


@query(f"WITH {_SCORES} SELECT 'overall/' || model || '/n' AS name, CAST(count(*) AS DOUBLE) AS value FROM scores GROUP BY model UNION ALL SELECT 'level/' || level || '/' || model || '/n', CAST(count(*) AS DOUBLE) FROM scores GROUP BY level, model")
def flat_metrics(spark, sf_dir):
    return report.flat_metrics(report.summary(scores(spark, sf_dir)).where("scope <> 'division'").select("scope", "value", "model", "n"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'finetuned' END AS model, label, count(*) AS n FROM (SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN ['wrong_columns', 'missing_join'] WHEN p_size > 10 THEN ['wrong_limit'] ELSE [] END) AS label FROM part) x GROUP BY 1, 2")
def failure_counts(spark, sf_dir):
    rows = t(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'finetuned' END AS model", "CASE WHEN p_size > 25 THEN array('wrong_columns', 'missing_join') WHEN p_size > 10 THEN array('wrong_limit') ELSE array() END AS failures")
    return report.failure_counts(rows)


@query(f"""WITH {PAIRS}, e AS (SELECT 'base' AS model, level, CASE WHEN {NORM.format('predicted').replace(';+$', ';$')} = {NORM.format('gold').replace(';+$', ';$')} THEN 1 ELSE 0 END AS same FROM pairs)
  SELECT model, level, count(*) AS n, CAST(sum(same) AS BIGINT) AS matches, round(avg(same), 4) AS rate FROM e GROUP BY GROUPING SETS ((model), (model, level))""")
def exact_match_by_level(spark, sf_dir):
    return report.exact_match(pairs(spark, sf_dir).withColumn("model", F.lit("base")))


@query("SELECT event_id AS step, round(value, 4) AS eval_loss FROM events ORDER BY value, event_id LIMIT 1")
def best_checkpoint(spark, sf_dir):
    log = t(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("eval_loss"))
    return report.best_checkpoint(log).select("step", F.round("eval_loss", 4).alias("eval_loss"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS trainable, round(100.0::DOUBLE * sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END) / sum(p_size), 4) AS percent FROM part")
def parameter_counts(spark, sf_dir):
    return report.parameter_counts(t(spark, sf_dir, "part").selectExpr("CAST(p_size AS BIGINT) AS count", "p_partkey % 3 = 0 AS trainable"))


@query("SELECT p.p_brand AS metric, p.base, p.finetuned, r.base AS run_base, r.finetuned AS run_finetuned, round(r.base - p.base, 4) AS delta_base, round(r.finetuned - p.finetuned, 4) AS delta_finetuned FROM (SELECT p_brand, round(avg(p_size), 3) AS base, round(max(p_size), 3)::DOUBLE AS finetuned FROM part GROUP BY 1) p LEFT JOIN (SELECT p_brand, round(avg(p_retailprice), 3) AS base, round(max(p_retailprice), 3) AS finetuned FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1) r USING (p_brand)")
def compared_with_published(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    published = part.groupBy(F.col("p_brand").alias("metric")).agg(F.round(F.avg("p_size"), 3).alias("base"), F.max("p_size").cast("double").alias("finetuned"))
    run = part.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("metric")).agg(F.round(F.avg("p_retailprice"), 3).alias("base"), F.round(F.max("p_retailprice"), 3).alias("finetuned"))
    return report.compared_with(published, run)


# -- records

_RECORDS = f"SELECT CAST(p_partkey AS VARCHAR) AS sql_validation_id, {LEVEL} AS nivel, {GOLD} AS sql_code_gold, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS sql_code_base, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS sql_code_finetuned FROM part"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_RECORDS.replace("VARCHAR", "STRING"))


@query(f"SELECT sql_validation_id FROM ({_RECORDS}) r WHERE trim(coalesce(sql_code_base, '')) <> '' OR trim(coalesce(sql_code_finetuned, '')) <> ''")
def comparable_filter(spark, sf_dir):
    return score.comparable(records(spark, sf_dir)).select("sql_validation_id")


@query(f"SELECT sql_validation_id AS id, nivel AS level, 'base' AS model, coalesce(sql_code_base, '') AS predicted FROM ({_RECORDS}) r UNION ALL SELECT sql_validation_id, nivel, 'finetuned', coalesce(sql_code_finetuned, '') FROM ({_RECORDS}) r")
def wide_to_long(spark, sf_dir):
    return score.long_form(records(spark, sf_dir)).select("id", "level", "model", "predicted")


@query(f"SELECT count(*) FILTER (WHERE trim(coalesce(sql_code_base, '')) <> '') AS base, count(*) FILTER (WHERE trim(coalesce(sql_code_finetuned, '')) <> '') AS finetuned FROM ({_RECORDS}) r")
def non_blank_counts(spark, sf_dir):
    return records(spark, sf_dir).agg(*(F.count_if(~text.is_blank(F.col(f"sql_code_{m}"))).alias(m) for m in score.MODELS))


@query("SELECT c_custkey AS id, c_name AS output_base, coalesce(s_name, '') AS output_finetuned FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def merge_predictions(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("output"))
    tuned = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("output"))
    return sequences.merged(base, tuned, "id", "output")


# -- result sets


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o, o.orderBy(F.desc("o_orderkey")), o.where("o_orderkey % 1000 <> 7"), o.unionByName(o.where("o_orderkey % 1000 = 8"))


def _verdicts(spark: SparkSession, sf_dir: str, equal: Callable[[DataFrame, DataFrame], bool]) -> DataFrame:
    """How a table compares with itself reordered, with rows missing, and with rows repeated."""
    same, turned, fewer, more = _sides(spark, sf_dir)
    return spark.createDataFrame([("reordered", equal(same, turned)), ("fewer", equal(same, fewer)), ("repeated", equal(same, more))], "side string, same boolean")


_FEWER = "(SELECT count(*) = 0 FROM orders WHERE o_orderkey % 1000 = 7)"
_MORE = "(SELECT count(*) = 0 FROM orders WHERE o_orderkey % 1000 = 8)"


@query(f"SELECT 'reordered' AS side, true AS same UNION ALL SELECT 'fewer', {_FEWER} UNION ALL SELECT 'repeated', true")
def cmp_set(spark, sf_dir):
    return _verdicts(spark, sf_dir, compare.same_set)


@query(f"SELECT 'reordered' AS side, true AS same UNION ALL SELECT 'fewer', {_FEWER} UNION ALL SELECT 'repeated', {_MORE}")
def cmp_multiset(spark, sf_dir):
    return _verdicts(spark, sf_dir, compare.same_multiset)


@query("SELECT 'as it is' AS side, true AS same UNION ALL SELECT 'turned', (SELECT count(*) < 2 FROM orders)")
def cmp_list(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    up, down = compare.indexed(o, "o_orderkey"), compare.indexed(o, F.desc("o_orderkey"))
    return spark.createDataFrame([("as it is", compare.same_list(up, compare.indexed(o, "o_orderkey"))), ("turned", compare.same_list(up, down))], "side string, same boolean")


@query("SELECT 'within ties' AS side, true AS same UNION ALL SELECT 'turned', (SELECT count(DISTINCT o_orderpriority) < 2 FROM orders)")
def cmp_ordered_robust(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    gold = compare.indexed(o, "o_orderpriority", "o_orderkey")
    ties, turned = compare.indexed(o, "o_orderpriority", F.desc("o_orderkey")), compare.indexed(o, F.desc("o_orderpriority"), "o_orderkey")
    return spark.createDataFrame([("within ties", compare.same_but_for_ties(ties, gold, [1])), ("turned", compare.same_but_for_ties(turned, gold, [1]))], "side string, same boolean")


@query("SELECT o_orderkey AS _c0, o_orderpriority AS _c1, CAST(CASE WHEN o_orderkey % 1000 = 7 THEN 1 ELSE -1 END AS BIGINT) AS surplus FROM orders WHERE o_orderkey % 1000 IN (7, 8)")
def cmp_differences(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return compare.differences(o, o.where("o_orderkey % 1000 <> 7").unionByName(o.where("o_orderkey % 1000 = 8")))


# -- sequences


def _tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.sequence(F.lit(1), F.col("p_size")).alias("ids"), F.floor(F.col("p_size") / 3).cast("int").alias("prompt"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, p_size + 1), lambda x: CASE WHEN x <= p_size // 3 THEN -100 ELSE x END), ' ') AS labels FROM part")
def label_mask(spark, sf_dir):
    return _tokens_of(spark, sf_dir).select("p_partkey", F.array_join(sequences.labels(F.col("ids"), F.col("prompt")).cast("array<string>"), " ").alias("labels"))


_BATCHED = "b AS (SELECT p_partkey, p_size, (row_number() OVER (ORDER BY p_partkey) - 1) // 4 AS batch FROM part), w AS (SELECT *, CAST(ceil(max(p_size) OVER (PARTITION BY batch) / 8.0) * 8 AS INTEGER) AS size FROM b)"


@query(f"WITH {_BATCHED} SELECT p_partkey, CAST(batch AS BIGINT) AS batch, size AS padded_to, array_to_string(list_concat(range(1, p_size + 1), list_transform(range(0, size - p_size), lambda i: 0)), ' ') AS input_ids, array_to_string(list_transform(range(0, size), lambda i: CASE WHEN i < p_size THEN 1 ELSE 0 END), ' ') AS attention_mask, array_to_string(list_transform(range(0, size), lambda i: CASE WHEN i < p_size // 3 OR i >= p_size THEN -100 ELSE i + 1 END), ' ') AS labels FROM w")
def pad_batch(spark, sf_dir):
    rows = sequences.padded_batches(sequences.batched(_tokens_of(spark, sf_dir), 4, ["p_partkey"]), "ids", "prompt", 0)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return rows.select("p_partkey", F.col("batch").cast("long").alias("batch"), "padded_to", joined("input_ids"), joined("attention_mask"), joined("labels"))


# -- what SQL does not express: rows only


@query()
def scored_pairs(spark, sf_dir):
    """Equivalence, structure, clauses, similarity and failures of every pair of texts."""
    p = pairs(spark, sf_dir).select("p_partkey", "level", F.lit("").alias("division"), F.lit("base").alias("model"), "gold", "predicted")
    s = score.score_pairs(p)
    return s.select("p_partkey", "ast_equivalent", "structural_precision", "structural_recall", "structural_f1", "component_jaccard", "string_similarity", "failures")


_WRONG = "(2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END)"


@query(f"""SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey % 5 = 0 AS ast_equivalent, CASE WHEN p_partkey % 7 = 0 THEN 0.0 WHEN p_partkey % 5 = 0 THEN 1.0 ELSE round((7 - {_WRONG}) / 7.0::DOUBLE, 4) END AS component_jaccard,
  CASE WHEN p_partkey % 7 = 0 THEN 'parse_error' WHEN p_partkey % 5 = 0 THEN 'correct' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'wrong_join_condition,' ELSE '' END || CASE WHEN p_partkey % 2 = 1 THEN 'wrong_condition_value,' ELSE '' END || 'wrong_order_by,wrong_limit' END AS failures FROM part""")
def pair_verdicts(spark, sf_dir):
    """What is wrong with each pair's query follows from how PREDICTED makes it: of seven clauses, two to four differ."""
    p = pairs(spark, sf_dir).select("p_partkey", "level", F.lit("").alias("division"), F.lit("base").alias("model"), "gold", "predicted")
    return score.score_pairs(p).select("p_partkey", "ast_equivalent", "component_jaccard", F.array_join("failures", ",").alias("failures"))


@query()
def pair_reports(spark, sf_dir):
    p = pairs(spark, sf_dir).select("p_partkey", "gold", "predicted")
    return score.report_json(score.score_pairs(p)).select("p_partkey", "report")


AUDITED = [("1", "easy", "SELECT n_name FROM nation ORDER BY n_name LIMIT 3"), ("2", "easy", "SELECT nothing FROM nation"), ("3", "hard", ""), ("4", "hard", "DROP TABLE nation"), ("5", "hard", "SELECT ST_HasGeometry(n_name) FROM nation")]


@query("SELECT * FROM (VALUES (0, '1', 'ok'), (1, '2', 'error'), (2, '3', 'empty'), (3, '4', 'error'), (4, '5', 'error')) v(row_index, id, status)")
def gold_audit(spark, sf_dir):
    files.register_tables(spark, sf_dir, TABLES)
    geo.register(spark)
    return execute.audit(spark, spark.createDataFrame(AUDITED, "id string, level string, sql_code string"), run=True).select("row_index", "id", "status")


EXECUTED = [
    ("same", "SELECT n_name FROM nation ORDER BY n_name", "select n_name from nation order by n_name", True), ("other order", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name", False),
    ("no order asked", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation", True), ("ties", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name DESC", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey", True),
    ("fails", "SELECT n_nam FROM nation", "SELECT n_name FROM nation", False), ("other count", "SELECT n_name FROM nation UNION ALL SELECT 'x'", "SELECT n_name FROM nation", False),
    ("types", "SELECT n_nationkey::numeric AS a FROM nation", "SELECT n_nationkey FROM nation", True),
]


@query("SELECT * FROM (VALUES ('same', true), ('other order', false), ('no order asked', true), ('ties', true), ('fails', false), ('other count', false), ('types', true)) v(name, match)")
def execution_accuracy(spark, sf_dir):
    files.register_tables(spark, sf_dir, TABLES)
    return spark.createDataFrame([(n, execute.execution_accuracy(spark, p, g, seconds=60).match) for n, p, g, _ in EXECUTED], "name string, match boolean")


@query()
def table_fingerprint(spark, sf_dir):
    f = split.fingerprint(t(spark, sf_dir, "part"))
    return spark.createDataFrame([(f["rows"], f["columns"], f["digest"])], "rows long, columns int, digest string")


@query()
def file_digests(spark, sf_dir):
    return files.md5_of_files(spark, f"{sf_dir}/nation.parquet").select("length", "md5")


# -- beyond the workload: one query for each kind that large tables of events need


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    w = t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
  s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    s = t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("first"), "n")


@query("""WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
  SELECT event_id, (SELECT max(p.ts) FROM p WHERE p.user_id = c.user_id AND p.ts <= c.ts) AS bought FROM c""")
def as_of_join(spark, sf_dir):
    """Each click with its user's last purchase so far: one pass over both in order of time, no join."""
    e = t(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    so_far = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.withColumn("bought", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(so_far))
    return seen.where("event_type = 'click'").select("event_id", "bought")


@query("SELECT a.p_partkey AS a, count(*) AS n FROM part a JOIN part b ON b.p_retailprice BETWEEN a.p_retailprice AND a.p_retailprice + 0.5 GROUP BY 1")
def interval_join(spark, sf_dir):
    """Prices in an interval: how many rows lie up to its end less how many before it, so no pair is made.

    Both come from one running total over the distinct prices and the ends of their intervals."""
    from meridian.operators.ordering import running_totals

    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("low")).where("low IS NOT NULL")
    prices = part.groupBy("low").agg(F.count(F.lit(1)).alias("rows"))
    end = lambda at, kind, rows: F.struct(at.alias("at"), F.lit(kind).alias("kind"), rows.alias("rows"))
    # At one price: first the intervals that begin there, then its rows, then the intervals that end there.
    ends = F.array(end(F.col("low"), 0, F.lit(0).cast("long")), end(F.col("low"), 1, F.col("rows")), end(F.col("low") + 0.5, 2, F.lit(0).cast("long")))
    placed = prices.select("low", F.explode(ends).alias("e")).select("low", "e.*")
    total = running_totals(placed, [F.col("at"), F.col("kind")], F.col("rows"), "total")
    counts = total.where("kind <> 1").groupBy("low").agg((F.max(F.when(F.col("kind") == 2, F.col("total"))) - F.max(F.when(F.col("kind") == 0, F.col("total")))).alias("n"))
    return part.groupBy("a", "low").agg(F.count(F.lit(1)).alias("times")).join(counts, "low").groupBy("a").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


@query()
def approximate_aggregates(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 1000).alias("median"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50")
def json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")
