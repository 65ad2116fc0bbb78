import math

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, shapes
from meridian.functions.shapes import from_wkt, to_geojson, to_wkt
from meridian.plans.dialect import to_spark

SQUARE = from_wkt("POLYGON((0 0,0 2,2 2,2 0,0 0))")
HOLED = from_wkt("POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,1 3,3 3,3 1,1 1))")
NEXT = from_wkt("POLYGON((2 0,2 2,4 2,4 0,2 0))")
OVER = from_wkt("POLYGON((1 1,1 3,3 3,3 1,1 1))")
FAR = from_wkt("POLYGON((9 9,9 10,10 10,10 9,9 9))")
LINE = from_wkt("LINESTRING(-1 1,3 1)")


def point(x, y):
    return from_wkt(f"POINT({x} {y})")


def test_points_in_polygons():
    assert shapes.contains(SQUARE, point(1, 1)) and not shapes.contains(SQUARE, point(0, 1)) and not shapes.contains(SQUARE, point(3, 1))
    assert not shapes.contains(HOLED, point(2, 2)) and shapes.contains(HOLED, point(0.5, 2)) and shapes.touches(SQUARE, point(0, 1))


def test_polygon_predicates():
    assert shapes.intersects(SQUARE, NEXT) and shapes.touches(SQUARE, NEXT) and not shapes.touches(SQUARE, OVER) and shapes.intersects(SQUARE, OVER)
    assert not shapes.intersects(SQUARE, FAR) and shapes.contains(HOLED, from_wkt("POLYGON((0 0,0 1,1 1,1 0,0 0))")) and not shapes.contains(HOLED, OVER)
    assert shapes.contains(SQUARE, SQUARE) and not shapes.touches(SQUARE, SQUARE) and shapes.intersects(SQUARE, LINE) and not shapes.contains(SQUARE, LINE)


def test_measures():
    assert shapes.area_of(HOLED) == 12 and shapes.length_of(LINE, "line") == 4 and shapes.length_of(SQUARE, "polygon") == 8
    assert shapes.distance(SQUARE, FAR) == pytest.approx(math.hypot(7, 7)) and shapes.distance(SQUARE, OVER) == 0 and shapes.distance(point(5, 1), SQUARE) == 3
    assert to_wkt(shapes.closest_point(SQUARE, point(5, 1))) == "POINT(2 1)" and to_wkt(shapes.centroid(SQUARE)) == "POINT(1 1)"
    assert shapes.haversine((0, 0), (0, 1)) == pytest.approx(111195, abs=1) and shapes.vincenty((0, 0), (0, 1)) == pytest.approx(110574, abs=2)


def test_constructions():
    assert shapes.area_of(shapes.intersection(SQUARE, OVER)) == 1 and shapes.intersection(SQUARE, FAR)["rings"] == []
    union = shapes.union([SQUARE, OVER])
    assert sum(abs(shapes.area(r)) for r in shapes.rings_of(union)) == 7
    round_ = shapes.buffer(point(0, 0), 2.0)
    assert shapes.area_of(round_) == pytest.approx(math.pi * 4, rel=0.01) and shapes.is_valid(round_)
    assert not shapes.is_valid(from_wkt("POLYGON((0 0,2 2,2 0,0 2,0 0))"))


def test_text_formats():
    for wkt in ("POINT(1 2)", "POLYGON((0 0,0 2,2 2,2 0,0 0))", "LINESTRING(-1 1,3 1)", "POINT EMPTY", "POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,1 3,3 3,3 1,1 1))"):
        assert to_wkt(from_wkt(wkt)) == wkt
    assert from_wkt("SRID=4674;POINT(-60.02 -3.1)")["srid"] == 4674 and to_geojson(point(1, 2)) == '{"type":"Point","coordinates":[1,2]}'
    with pytest.raises(ValueError):
        from_wkt("CIRCLE(1)")


def test_srids_do_not_mix():
    with pytest.raises(ValueError):
        shapes.intersects(SQUARE, {**NEXT, "srid": 4674})


def test_polyconic():
    x, y = shapes.rings_of(shapes.transform({**point(-54, 0), "srid": 4674}, 5880))[0][0]
    assert (x, y) == (5_000_000, 10_000_000)
    x, y = shapes.rings_of(shapes.transform({**point(-60, -3), "srid": 4674}, 5880))[0][0]
    assert x == pytest.approx(4_333_500, rel=1e-3) and y == pytest.approx(9_666_000, rel=1e-3)


def test_columns_agree_with_shapes(spark):
    geo.register(spark)
    wkts = ["POLYGON((0 0,0 2,2 2,2 0,0 0))", "POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,1 3,3 3,3 1,1 1))", "LINESTRING(-1 1,3 1)", "POINT(1 1)", None]
    df = spark.createDataFrame([(w,) for w in wkts], "w string").withColumn("g", geo.st_geomfromtext(F.col("w")))
    g = F.col("g")
    rows = df.select("w", "g", geo.st_area(g).alias("area"), geo.st_length(g).alias("length"), geo.st_perimeter(g).alias("perimeter"), geo.st_astext(geo.st_centroid(g)).alias("centre"), geo.st_isempty(g).alias("empty"), geo.st_astext(geo.st_envelope(g)).alias("box"), geo.inside(g, F.lit(0.5), F.lit(0.5)).alias("inside"))
    for r in rows.collect():
        if r.w is None:
            assert r.area is None and r.centre is None and r.box is None
            continue
        shape = r.g.asDict(recursive=True)
        assert r.area == shapes.area_of(shape) and r.length == shapes.length_of(shape, "line") and r.perimeter == shapes.length_of(shape, "polygon")
        assert r.centre == to_wkt(shapes.centroid(shape)) and r.box == to_wkt(shapes.envelope(shape)) and not r.empty
        assert r.inside == (shape["kind"] == "polygon" and shapes.place(shape, (0.5, 0.5)) > 0)


def test_sql_functions(spark):
    geo.register(spark)
    sql = """SELECT ST_AsText(ST_Buffer(ST_MakePoint(0, 0), 0)) AS a, ST_Distance(ST_SetSRID(ST_MakePoint(0, 0), 4674)::geography, ST_SetSRID(ST_MakePoint(0, 1), 4674)::geography) AS d,
      ST_DWithin(ST_MakePoint(0, 0), ST_MakePoint(3, 4), 5) AS w, ST_Area(ST_Intersection(ST_MakeEnvelope(0, 0, 2, 2), ST_MakeEnvelope(1, 1, 3, 3))) AS i, ST_SRID(ST_GeomFromText('POINT(1 1)', 4674)) AS s,
      ST_Within(ST_MakePoint(1, 1), ST_MakeEnvelope(0, 0, 2, 2)) AS n, round(ST_DistanceSphere(ST_MakePoint(0, 0), ST_MakePoint(0, 1))::numeric, 0) AS m"""
    r = spark.sql(to_spark(sql)).first()
    assert r.a == "POLYGON EMPTY" and r.d == pytest.approx(111195, abs=1) and r.w and r.i == 1.0 and r.s == 4674 and r.n and int(r.m) == 111195
    sums = spark.sql(to_spark("SELECT ST_AsText(ST_Extent(g)) AS e, ST_AsText(ST_Union(g)) AS u FROM (SELECT ST_MakePoint(x, x * 2) AS g FROM (VALUES (1), (2)) v(x)) t")).first()
    assert sums.e == "POLYGON((1 2,1 4,2 4,2 2,1 2))" and sums.u == "MULTIPOINT((1 2),(2 4))"


def test_intersection_of_boxes_and_others(spark):
    """Boxes are met in the plan, other pairs in Python: both give the area that the shapes share, an empty one too."""
    made = [(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0), (2.0, 0.0, 4.0, 1.0), (5.0, 5.0, 6.0, 6.0), (0.5, 0.5, 1.0, 1.5)]
    texts = ["POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((0 0,4 0,0 4,0 0))"]
    boxes = spark.createDataFrame([(i, *b) for i, b in enumerate(made)], "i int, a double, b double, c double, d double").select("i", geo.st_makeenvelope(*(F.col(c) for c in "abcd")).alias("g"))
    others = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "i int, t string").select("i", geo.st_geomfromtext("t").alias("g"))
    rows = boxes.unionByName(others)
    pairs = rows.join(rows.select(F.col("i").alias("j"), F.col("g").alias("h")), F.col("i") <= F.col("j"))
    for r in pairs.select("i", "j", "g", "h", geo.st_intersection(F.col("g"), F.col("h")).alias("x")).collect():
        plain = [{**s.asDict(), "rings": [[{"x": p.x, "y": p.y} for p in ring] for ring in s.rings]} for s in (r.g, r.h, r.x)]
        wanted = shapes.intersection(plain[0], plain[1])
        assert shapes.area_of(plain[2]) == shapes.area_of(wanted) and shapes.box(plain[2]) == shapes.box(wanted), (r.i, r.j)
    nothing = spark.range(1).select(geo.st_intersection(F.lit(None).cast(geo.GEOMETRY), geo.st_makeenvelope(*map(F.lit, made[0]))).alias("x"))
    assert nothing.first().x is None
