"""Spatial conditions of SQL text: planned on cells, and equal to brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meridian import queries
from meridian.functions import geo, shapes
from meridian.operators import spatial
from meridian.plans.dialect import to_spark


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def views(spark):
    geo.register(spark)
    rng = random.Random(4)
    ring = lambda x, y, r, n: [(x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    areas = []
    for i in range(60):
        spots = ring(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.01, 0.3, 2, 8]), rng.randint(3, 9))
        areas.append((i, shapes.make("polygon", [[*spots, spots[0]]], srid=4674)))
    points = [(i, shapes.make("point", [[(rng.uniform(-9, 9), rng.uniform(-9, 9))]], srid=4674)) for i in range(150)]
    points += [(900, None), (901, shapes.make("point", [], srid=4674)), (902, areas[0][1] and shapes.make("point", [[shapes.rings_of(areas[0][1])[0][0]]], srid=4674))]
    far = [(179.95, 0.0), (-179.95, 0.0), (10.0, 89.99), (-170.0, 89.99), (20.0, 70.0), (20.2, 70.05), (-179.99, 70.0), (179.9, 70.02), (0.0, -89.9), (180.0, 10.0), (-180.0, 10.0), (0.0, 0.0)]
    world = [(i, *p) for i, p in enumerate(far + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(250)])]
    frame = lambda rows: spark.createDataFrame(rows, f"id int, g {geo.GEOMETRY}")
    frame(areas).createOrReplaceTempView("areas")
    frame(points).createOrReplaceTempView("spots")
    spark.createDataFrame(world, "id int, x double, y double").createOrReplaceTempView("world")
    return areas, points, world


@pytest.mark.parametrize(
    "name,left,right",
    [("ST_Contains", "areas", "spots"), ("ST_Within", "spots", "areas"), ("ST_Intersects", "areas", "areas"), ("ST_Touches", "areas", "areas"), ("ST_DWithin", "spots", "areas"), ("ST_DWithin", "areas", "areas")],
)
def test_joins_equal_brute_force(spark, views, name, left, right):
    rows = {"areas": views[0], "spots": views[1]}
    test = {"ST_Contains": shapes.contains, "ST_Within": lambda a, b: shapes.contains(b, a), "ST_Intersects": shapes.intersects, "ST_Touches": shapes.touches, "ST_DWithin": lambda a, b: (shapes.distance(a, b) if shapes.box(a) else 9) <= 0.4}[name]
    df = spark.sql(to_spark(f"SELECT a.id AS i, b.id AS j FROM {left} a JOIN {right} b ON {name}(a.g, b.g{', 0.4' if 'DW' in name else ''})"))
    assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)
    got = [(r.i, r.j) for r in df.collect()]
    want = [(i, j) for i, a in rows[left] for j, b in rows[right] if a and b and shapes.box(a) and shapes.box(b) and test(a, b)]
    assert sorted(got) == sorted(want) and (want or name == "ST_Touches")


def test_stars_hide_the_cells(spark, views):
    for sql, columns in (("SELECT * FROM areas a, spots b WHERE ST_Contains(a.g, b.g) AND a.id < 5", ["id", "g", "id", "g"]), ("SELECT b.*, a.id AS k FROM areas a JOIN spots b ON ST_Contains(a.g, b.g)", ["id", "g", "k"])):
        df = spark.sql(to_spark(sql))
        assert df.columns == columns and "NestedLoop" not in plan(df)


def test_what_is_left_alone():
    for sql in ("SELECT 1 FROM a LEFT JOIN b ON ST_Contains(a.g, b.g)", "SELECT 1 FROM a JOIN b ON ST_Contains(g, h)", "SELECT 1 FROM a WHERE EXISTS (SELECT 1 FROM b WHERE ST_Contains(a.g, b.g))", "SELECT 1 FROM a, b WHERE ST_DWithin(a.g, b.g, a.d)"):
        assert "geo_cells" not in to_spark(sql)


def near_pairs(world, metres):
    return sorted((i, j) for i, *p in world for j, *q in world if shapes.haversine(p, q) <= metres)


@pytest.mark.parametrize("metres", [20_000.0, 900_000.0, 11_000_000.0])
def test_distances_round_the_earth(spark, views, metres):
    want = near_pairs(views[2], metres)
    w = spark.table("world")
    a, b = (w.select(*(F.col(c).alias(f"{s}{c}") for c in w.columns)) for s in "ab")
    got = spatial.join_within(a, b, (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), metres, geodetic=True)
    assert sorted((r.aid, r.bid) for r in got.collect()) == want
    df = spark.sql(to_spark(f"SELECT a.id AS i, b.id AS j FROM world a JOIN world b ON ST_DWithin(ST_MakePoint(a.x, a.y)::geography, ST_MakePoint(b.x, b.y)::geography, {metres})"))
    assert "NestedLoop" not in plan(df)
    assert sorted((r.i, r.j) for r in df.collect()) == [p for p in want]


@pytest.mark.parametrize("name", ["sql_st_contains", "sql_st_intersects", "sql_st_dwithin", "sql_st_touches", "sql_st_within_chain"])
def test_registered_plans(spark, sf, name):
    p = plan(queries.QUERIES[name](spark, sf))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_inside_equals_brute_force(spark, views):
    """Polygons of any form: circles around their middles decide most points, edges the rest."""
    areas, points = spark.table("areas").select("id", "g"), spark.table("world").select(F.col("id").alias("k"), (F.col("x") / 20.0).alias("x"), (F.col("y") / 10.0).alias("y"))
    got = {(r.id, r.k) for r in spatial.join_inside(areas, points, "g", F.col("x"), F.col("y")).collect()}
    want = {(i, k) for i, g in views[0] for k, x, y in views[2] if shapes.place(g, (x / 20.0, y / 10.0)) > 0}
    assert got == want and want


def test_nearest_in_crowds(spark):
    """Most points in a few places and close together: the first cell follows them, results are those of brute force."""
    rng = random.Random(8)
    spots = [(i, 1.0, 1.0) for i in range(60)] + [(60 + i, 1 + rng.random() / 500, 1 + rng.random() / 500) for i in range(400)] + [(500, 9.0, -7.0), (501, -40.0, 3.0)]
    seek = [(i, rng.uniform(0.9, 1.1), rng.uniform(0.9, 1.1)) for i in range(80)] + [(80, 50.0, 50.0), (81, 1.0, 1.0)]
    a, b = spark.createDataFrame(seek, "k int, x double, y double"), spark.createDataFrame(spots, "s int, sx double, sy double")
    b_xy = (F.col("sx"), F.col("sy"))
    assert spatial._first_cell(b, b_xy, 2, 0.3) < 0.01
    got = {(r.k, r["rank"], r.s) for r in spatial.nearest(a, b, "k", (F.col("x"), F.col("y")), b_xy, 2, ["s"], 0.3).collect()}
    near = lambda x, y: sorted((math.sqrt((p - x) * (p - x) + (q - y) * (q - y)), s) for s, p, q in spots)[:2]
    assert got == {(k, n + 1, s) for k, x, y in seek for n, (_, s) in enumerate(near(x, y))}


def test_pairs_are_dealt_to_many_tasks(spark, sf):
    """Small files broadcast a side and leave all pairs to the few tasks that read the other; joins on cells are shuffled."""
    for name in ("st_dwithin_join", "st_buffer_contains", "st_buffer_polygon", "st_intersects_self", "st_contains_join"):
        p = plan(queries.QUERIES[name](spark, sf))
        assert "REPARTITION_BY_NUM" in p and "SortMergeJoin" in p and "BroadcastHashJoin" not in p


@pytest.mark.parametrize("name", ["ST_Contains", "ST_Within", "ST_Intersects", "ST_Touches", "ST_DWithin"])
def test_points_and_boxes_are_tested_in_the_join(spark, views, name):
    """Corners, edges, insides and equal shapes; Python sees no pair of two points or boxes."""
    box = lambda a, b, c, d: shapes.make("polygon", [[(a, b), (a, d), (c, d), (c, b), (a, b)]], srid=4674)
    point = lambda x, y: shapes.make("point", [[(x, y)]], srid=4674)
    given = [box(0, 0, 4, 4), box(0, 0, 4, 4), box(1, 1, 2, 2), box(4, 0, 6, 2), box(4, 4, 5, 5), box(0, 1, 4, 2), box(-1, 2, 7, 3), box(9, 9, 10, 10)]
    given += [point(0, 0), point(1, 1), point(1, 1), point(4, 3), point(2, 3), point(9.5, 9.5), shapes.make("polygon", [[(0, 0), (3, 0), (0, 3), (0, 0)]], srid=4674)]
    rows = list(enumerate(given))
    spark.createDataFrame(rows, f"id int, g {geo.GEOMETRY}").createOrReplaceTempView("mixed")
    test = {"ST_Contains": shapes.contains, "ST_Within": lambda a, b: shapes.contains(b, a), "ST_Intersects": shapes.intersects, "ST_Touches": shapes.touches, "ST_DWithin": lambda a, b: shapes.distance(a, b) <= 1.0}[name]
    df = spark.sql(to_spark(f"SELECT a.id AS i, b.id AS j FROM mixed a JOIN mixed b ON {name}(a.g, b.g{', 1.0' if 'DW' in name else ''})"))
    assert sorted((r.i, r.j) for r in df.collect()) == sorted((i, j) for i, a in rows for j, b in rows if test(a, b))
    assert "CASE WHEN NOT coalesce" in to_spark(f"SELECT 1 FROM mixed a JOIN mixed b ON {name}(a.g, b.g{', 1.0' if 'DW' in name else ''})")
    assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
