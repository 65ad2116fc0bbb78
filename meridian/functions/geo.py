"""Geometries as Spark structs and PostGIS-style functions on them.

A geometry is struct<kind, srid, geodetic, rings>: `kind` is point, line or polygon; a point has one ring of one
position, a line one ring for each line, a polygon its rings, closed, whose overlaps count by the even-odd rule, so
holes and several parts need no types of their own. `geodetic` marks PostGIS's geography: measures are metres.

Measures and predicates that a Column expression can state are ones (bounding boxes, ray casting, shoelace sums,
great-circle distances). What builds or intersects general shapes is an Arrow function over `meridian.functions.shapes`.
Null geometries give null. Geometries of different srid do not mix: binary functions raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import shapes

_POSITION = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY_TYPE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("geodetic", T.BooleanType()), T.StructField("rings", T.ArrayType(T.ArrayType(_POSITION))),
])
GEOMETRY = GEOMETRY_TYPE.simpleString()
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
SHAPE = "struct<t:int,srid:int,geodetic:boolean,xmin:double,ymin:double,xmax:double,ymax:double>"
SRID, RADIUS = 4674, 6371008.8


def _geometry(kind: str, srid: Column | int, rings: Column, geodetic: Column | bool = False) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("kind"), lit(srid).cast("int").alias("srid"), lit(geodetic).alias("geodetic"), rings.alias("rings"))


def position(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def st_makepoint(x: Column, y: Column, srid: int = 0) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), _geometry("point", srid, F.array(F.array(position(x, y)))))


def st_makeenvelope(xmin: Column, ymin: Column, xmax: Column, ymax: Column, srid: Column | int = 0) -> Column:
    corners = F.array(position(xmin, ymin), position(xmin, ymax), position(xmax, ymax), position(xmax, ymin), position(xmin, ymin))
    return F.when(xmin.isNotNull() & ymin.isNotNull() & xmax.isNotNull() & ymax.isNotNull(), _geometry("polygon", srid, F.array(corners)))


def st_setsrid(g: Column, srid: Column | int) -> Column:
    return F.when(g.isNotNull(), g.withField("srid", srid if isinstance(srid, Column) else F.lit(srid)))


def to_geography(g: Column) -> Column:
    return F.when(g.isNotNull(), g.withField("geodetic", F.lit(True)))


def to_geometry(g: Column) -> Column:
    return F.when(g.isNotNull(), g.withField("geodetic", F.lit(False)))


def st_srid(g: Column) -> Column:
    return g["srid"]


def st_x(g: Column) -> Column:
    return F.when(g["kind"] == "point", F.try_element_at(F.try_element_at(g["rings"], F.lit(1)), F.lit(1))["x"])


def st_y(g: Column) -> Column:
    return F.when(g["kind"] == "point", F.try_element_at(F.try_element_at(g["rings"], F.lit(1)), F.lit(1))["y"])


def st_isempty(g: Column) -> Column:
    return F.size(F.flatten(g["rings"])) <= 0


def _extreme(g: Column, field: str, which: Callable[[Column], Column]) -> Column:
    return which(F.transform(F.flatten(g["rings"]), lambda p: p[field]))


def st_xmin(g: Column) -> Column:
    return _extreme(g, "x", F.array_min)


def st_xmax(g: Column) -> Column:
    return _extreme(g, "x", F.array_max)


def st_ymin(g: Column) -> Column:
    return _extreme(g, "y", F.array_min)


def st_ymax(g: Column) -> Column:
    return _extreme(g, "y", F.array_max)


def st_envelope(g: Column) -> Column:
    return st_makeenvelope(st_xmin(g), st_ymin(g), st_xmax(g), st_ymax(g), g["srid"])


def st_translate(g: Column, dx: Column, dy: Column) -> Column:
    moved = F.transform(g["rings"], lambda r: F.transform(r, lambda p: position(p["x"] + dx, p["y"] + dy)))
    return F.when(g.isNotNull(), g.withField("rings", moved))


def st_boundary(g: Column) -> Column:
    """A polygon's rings as lines, a line's two ends as points of one ring each; nothing for a point."""
    ends = F.flatten(F.transform(g["rings"], lambda r: F.array(F.slice(r, F.lit(1), F.lit(1)), F.slice(r, F.lit(-1), F.lit(1)))))
    rings = F.when(g["kind"] == "polygon", g["rings"]).when(g["kind"] == "line", ends).otherwise(F.slice(g["rings"], F.lit(1), F.lit(0)))
    return F.when(g.isNotNull(), g.withField("rings", rings).withField("kind", F.when(g["kind"] == "polygon", "line").otherwise("point")))


# -- distances of positions


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two positions in degrees, on a sphere."""
    rad = lambda c: c * F.lit(math.pi / 180.0)
    h = F.pow(F.sin((rad(y2) - rad(y1)) / 2.0), F.lit(2.0)) + F.cos(rad(y1)) * F.cos(rad(y2)) * F.pow(F.sin((rad(x2) - rad(x1)) / 2.0), F.lit(2.0))
    return F.lit(2.0 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def point_distance(a: Column, b: Column) -> Column:
    """Of two points: metres if they are geographies, else in their units."""
    ax, ay, bx, by = st_x(a), st_y(a), st_x(b), st_y(b)
    return F.when(a["geodetic"] & b["geodetic"], haversine(ax, ay, bx, by)).otherwise(planar(ax, ay, bx, by))


def st_distancesphere(a: Column, b: Column) -> Column:
    return haversine(st_x(a), st_y(a), st_x(b), st_y(b))


# -- rings


def _edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of a ring's edges."""
    n = F.size(ring) - 1
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(n, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.when(n > 0, pairs).otherwise(F.slice(pairs, F.lit(1), F.lit(0)))


def _all_edges(g: Column) -> Column:
    return F.flatten(F.transform(g["rings"], _edges))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def st_area(g: Column) -> Column:
    """Of a polygon, in square units: its first ring less the others' areas by the shoelace sum; 0 for other kinds."""
    rings = F.transform(g["rings"], lambda r: F.abs(_sum(F.transform(_edges(r), _cross))) / 2.0)
    area = F.transform(F.array(rings), lambda r: F.coalesce(F.try_element_at(r, F.lit(1)), F.lit(0.0)) * 2.0 - _sum(r))[0]
    return F.when(g["kind"] == "polygon", area).when(g.isNotNull(), 0.0)


def _length(g: Column) -> Column:
    way = lambda e: F.when(g["geodetic"], haversine(e["x1"], e["y1"], e["x2"], e["y2"])).otherwise(planar(e["x1"], e["y1"], e["x2"], e["y2"]))
    return _sum(F.transform(_all_edges(g), way))


def st_length(g: Column) -> Column:
    return F.when(g["kind"] == "line", _length(g)).when(g.isNotNull(), 0.0)


def st_perimeter(g: Column) -> Column:
    return F.when(g["kind"] == "polygon", _length(g)).when(g.isNotNull(), 0.0)


def _weighted(edges: Column, weight: Callable[[Column], Column]) -> Column:
    """(w, x, y) in one pass: the edges' weights, and their ends' coordinates times these, summed."""
    add = lambda s, e: F.struct((s["w"] + weight(e)).alias("w"), *((s[f] + (e[f + "1"] + e[f + "2"]) * weight(e)).alias(f) for f in "xy"))
    return F.aggregate(edges, F.struct(*(F.lit(0.0).alias(f) for f in "wxy")), add)


def st_centroid(g: Column) -> Column:
    """A polygon's by the area of its first ring, a line's by the length of its edges, a point's own."""
    first = F.flatten(F.transform(F.slice(g["rings"], F.lit(1), F.lit(1)), _edges))
    length = lambda e: planar(e["x1"], e["y1"], e["x2"], e["y2"])
    sums = F.when(g["kind"] == "polygon", _weighted(first, _cross)).when(g["kind"] == "line", _weighted(_all_edges(g), length))
    mean = lambda f: _sum(F.transform(F.flatten(g["rings"]), lambda p: p[f])) / F.nullif(F.size(F.flatten(g["rings"])).cast("double"), F.lit(0.0))
    at = lambda s, f: F.coalesce(s[f] / (F.nullif(s["w"], F.lit(0.0)) * F.when(g["kind"] == "polygon", 3.0).otherwise(2.0)), mean(f))
    centre = F.transform(F.array(sums), lambda s: position(at(s, "x"), at(s, "y")))
    return F.transform(centre, lambda p: F.when(p["x"].isNotNull(), _geometry("point", g["srid"], F.array(F.array(p)), g["geodetic"])))[0]


# -- predicates of a polygon and a position


def on_edges(edges: Column, x: Column, y: Column) -> Column:
    within = lambda a, b, c: (F.least(a, b) <= c) & (c <= F.greatest(a, b))
    return F.exists(edges, lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & within(e["x1"], e["x2"], x) & within(e["y1"], e["y2"], y))


def inside(g: Column, x: Column, y: Column) -> Column:
    """Whether a position is in a polygon's interior (on its boundary: no)."""
    edges = _all_edges(g)
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y1"] != e["y2"], e["y2"] - e["y1"]) + e["x1"])
    crossed = F.size(F.filter(edges, crosses))
    return (crossed % 2 == 1) & ~on_edges(edges, x, y)


def core_radius(g: Column, x: Column, y: Column) -> Column:
    """The radius of a circle around a position that lies in a polygon's interior, a little less than the largest; 0 outside it."""

    def apart(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = dx * dx + dy * dy
        along = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
        return planar(x, y, e["x1"] + along * dx, e["y1"] + along * dy)

    least = F.array_min(F.transform(_all_edges(g), apart))
    size = F.greatest(*(F.abs(f(g)) for f in (st_xmin, st_xmax, st_ymin, st_ymax)))
    return F.when((g["kind"] == "polygon") & inside(g, x, y), F.greatest(F.lit(0.0), least * (1.0 - 1e-9) - size * 1e-12)).otherwise(0.0)


def reach_radius(g: Column, x: Column, y: Column) -> Column:
    """The radius of a circle around a position that holds all of a geometry, a little more than the least."""
    size = F.greatest(*(F.abs(f(g)) for f in (st_xmin, st_xmax, st_ymin, st_ymax)))
    return F.array_max(F.transform(F.flatten(g["rings"]), lambda p: planar(x, y, p["x"], p["y"]))) * (1.0 + 1e-9) + size * 1e-12


def one_srid(a: Column, b: Column, value: Column) -> Column:
    """The value; an error where two geometries' srids differ."""
    message = F.concat(F.lit("operation on mixed srid geometries: "), a["srid"].cast("string"), F.lit(", "), b["srid"].cast("string"))
    return F.when((a["srid"] == b["srid"]) | a.isNull() | b.isNull(), value).otherwise(F.raise_error(message))


def st_contains_point(polygon: Column, point: Column) -> Column:
    return one_srid(polygon, point, inside(polygon, st_x(point), st_y(point)))


def st_covers_point(polygon: Column, point: Column) -> Column:
    return inside(polygon, st_x(point), st_y(point)) | on_edges(_all_edges(polygon), st_x(point), st_y(point))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


# -- text


def st_aswkt_point(g: Column) -> Column:
    return F.concat(F.lit("POINT("), st_x(g).cast("string"), F.lit(" "), st_y(g).cast("string"), F.lit(")"))


# -- Arrow functions for general shapes


_ARROW = {
    "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "string": (T.StringType(), pa.string()),
    GEOMETRY: (GEOMETRY_TYPE, pa.struct([("kind", pa.string()), ("srid", pa.int32()), ("geodetic", pa.bool_()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])),
}


def _arrow(result: str, f: Callable) -> Callable[..., Column]:
    """A Spark function that calls `f` with Python values; null if any of them is."""
    spark_type, arrow_type = _ARROW[result]

    @F.arrow_udf(spark_type)
    def run(*columns: pa.Array) -> pa.Array:
        if any(c.null_count == len(c) for c in columns):
            return pa.nulls(len(columns[0]), arrow_type)
        return pa.array([None if any(v is None for v in row) else f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], arrow_type)

    return run


@F.arrow_udf(GEOMETRY_TYPE)
def _union(groups: pa.Array) -> pa.Array:
    return pa.array([None if x is None else shapes.union([g for g in x if g is not None]) for x in groups.to_pylist()], groups.type.value_type)


st_intersects = _arrow("boolean", shapes.intersects)
st_contains = _arrow("boolean", shapes.contains)
st_within = lambda a, b: st_contains(b, a)
st_touches = _arrow("boolean", shapes.touches)
st_distance = _arrow("double", shapes.distance)
st_dwithin = _arrow("boolean", lambda a, b, d: shapes.distance(a, b) <= d)
_intersection = _arrow(GEOMETRY, shapes.intersection)
st_buffer = _arrow(GEOMETRY, shapes.buffer)
st_closestpoint = _arrow(GEOMETRY, shapes.closest_point)
st_geomfromtext = _arrow(GEOMETRY, shapes.from_wkt)
st_astext = _arrow("string", shapes.to_wkt)
st_asgeojson = _arrow("string", shapes.to_geojson)
st_isvalid = _arrow("boolean", shapes.is_valid)
st_transform = _arrow(GEOMETRY, shapes.transform)
st_union = _arrow(GEOMETRY, lambda a, b: shapes.union([a, b]))


def _corner(g: Column, i: int) -> Column:
    return F.try_element_at(F.try_element_at(g["rings"], F.lit(1)), F.lit(i))


def is_box(g: Column) -> Column:
    """Whether a polygon is one ring along the axes, so that its first and third corners tell it."""
    a, b, c, d = (_corner(g, i) for i in range(1, 5))
    turns = lambda f, s: (a[f] == b[f]) & (b[s] == c[s]) & (c[f] == d[f]) & (d[s] == a[s])
    closed = (a["x"] == _corner(g, 5)["x"]) & (a["y"] == _corner(g, 5)["y"])
    single = (g["kind"] == "polygon") & (F.size(g["rings"]) == 1) & (F.size(F.try_element_at(g["rings"], F.lit(1))) == 5)
    return F.coalesce(single & closed & (turns("x", "y") | turns("y", "x")), F.lit(False))


def st_intersection(a: Column, b: Column) -> Column:
    """What two shapes share. Two boxes are met in the plan itself; only other pairs go to Python."""
    boxes = is_box(a) & is_box(b) & F.coalesce(a["srid"] == b["srid"], F.lit(False))
    ends = lambda g, f: (F.least(_corner(g, 1)[f], _corner(g, 3)[f]), F.greatest(_corner(g, 1)[f], _corner(g, 3)[f]))
    (x, x_to), (y, y_to) = ((F.greatest(ends(a, f)[0], ends(b, f)[0]), F.least(ends(a, f)[1], ends(b, f)[1])) for f in "xy")
    corners = F.array(position(x, y), position(x, y_to), position(x_to, y_to), position(x_to, y), position(x, y))
    shared = F.when((x < x_to) & (y < y_to), F.array(corners)).otherwise(F.slice(a["rings"], F.lit(1), F.lit(0)))
    return F.when(boxes, _geometry("polygon", a["srid"], shared, a["geodetic"])).otherwise(_intersection(F.when(~boxes, a), F.when(~boxes, b)))


union_of = _union  # of an array of geometries: st_union(collect_list(g))

#: SQL functions by signature: result type and body.
_SQL = {
    "st_makepoint(x double, y double)": (GEOMETRY, "named_struct('kind', 'point', 'srid', 0, 'geodetic', false, 'rings', array(array(named_struct('x', x, 'y', y))))"),
    "st_makeenvelope(a double, b double, c double, d double, s int)": (
        GEOMETRY,
        "named_struct('kind', 'polygon', 'srid', s, 'geodetic', false, 'rings', array(array(named_struct('x', a, 'y', b), named_struct('x', a, 'y', d), named_struct('x', c, 'y', d), named_struct('x', c, 'y', b), named_struct('x', a, 'y', b))))",
    ),
    f"geo_setsrid(g {GEOMETRY}, s int)": (GEOMETRY, "CASE WHEN g IS NOT NULL THEN named_struct('kind', g.kind, 'srid', s, 'geodetic', g.geodetic, 'rings', g.rings) END"),
    f"to_geography(g {GEOMETRY})": (GEOMETRY, "CASE WHEN g IS NOT NULL THEN named_struct('kind', g.kind, 'srid', g.srid, 'geodetic', true, 'rings', g.rings) END"),
    f"to_geometry(g {GEOMETRY})": (GEOMETRY, "CASE WHEN g IS NOT NULL THEN named_struct('kind', g.kind, 'srid', g.srid, 'geodetic', false, 'rings', g.rings) END"),
    f"geo_srid(g {GEOMETRY})": ("int", "g.srid"),
    f"st_x(g {GEOMETRY})": ("double", "CASE WHEN g.kind = 'point' THEN try_element_at(try_element_at(g.rings, 1), 1).x END"),
    f"st_y(g {GEOMETRY})": ("double", "CASE WHEN g.kind = 'point' THEN try_element_at(try_element_at(g.rings, 1), 1).y END"),
    **{f"st_{which}{axis}_of(g {GEOMETRY})": ("double", f"array_{which}(transform(flatten(g.rings), p -> p.{axis}))") for which in ("min", "max") for axis in ("x", "y")},
    f"st_isempty(g {GEOMETRY})": ("boolean", "size(flatten(g.rings)) <= 0"),
    f"geo_box(g {GEOMETRY})": (BOX, "named_struct(" + ", ".join(f"'{a}{w}', array_{w}(transform(flatten(g.rings), p -> p.{a}))" for w in ("min", "max") for a in "xy") + ")"),
    # What decides predicates of points (t 1) and of boxes along the axes (t 2) without their rings; t is 0 for other shapes.
    f"geo_shape(g {GEOMETRY})": (SHAPE, """element_at(transform(array(geo_box(g)), b -> named_struct('t', CASE
        WHEN NOT coalesce(greatest(abs(b.xmin), abs(b.xmax), abs(b.ymin), abs(b.ymax)) < 1e300D, false) OR size(g.rings) <> 1 THEN 0
        WHEN g.kind = 'point' THEN CASE WHEN size(get(g.rings, 0)) = 1 THEN 1 ELSE 0 END
        WHEN coalesce(g.kind = 'polygon' AND size(get(g.rings, 0)) = 5 AND b.xmin < b.xmax AND b.ymin < b.ymax AND get(get(g.rings, 0), 0) = get(get(g.rings, 0), 4)
          AND (get(get(g.rings, 0), 0).x = get(get(g.rings, 0), 1).x AND get(get(g.rings, 0), 1).y = get(get(g.rings, 0), 2).y AND get(get(g.rings, 0), 2).x = get(get(g.rings, 0), 3).x AND get(get(g.rings, 0), 3).y = get(get(g.rings, 0), 0).y
            OR get(get(g.rings, 0), 0).y = get(get(g.rings, 0), 1).y AND get(get(g.rings, 0), 1).x = get(get(g.rings, 0), 2).x AND get(get(g.rings, 0), 2).y = get(get(g.rings, 0), 3).y AND get(get(g.rings, 0), 3).x = get(get(g.rings, 0), 0).x), false) THEN 2
        ELSE 0 END, 'srid', g.srid, 'geodetic', g.geodetic, 'xmin', b.xmin, 'ymin', b.ymin, 'xmax', b.xmax, 'ymax', b.ymax)), 1)"""),
    # Widened by d: degrees of a great circle for a geography (all longitudes where it would cross a pole or the date line), else units.
    f"geo_box_within(g {GEOMETRY}, d double)": (BOX, f"""element_at(transform(transform(transform(array(geo_box(g)),
        b -> named_struct('b', b, 'far', greatest(abs(b.ymin), abs(b.ymax)), 'dy', CASE WHEN g.geodetic THEN degrees(d / {RADIUS}D) * 1.000001D + 1e-12D ELSE d END)),
        s -> named_struct('b', s.b, 'dy', s.dy, 'dx', CASE WHEN NOT g.geodetic THEN d WHEN s.far + s.dy >= 90 THEN 360D ELSE degrees(asin(least(1D, sin(radians(s.dy)) / cos(radians(s.far))))) * 1.000001D END)),
        s -> CASE WHEN g.geodetic AND (s.b.xmin - s.dx < -180 OR s.b.xmax + s.dx > 180) THEN named_struct('xmin', least(s.b.xmin, -180D), 'ymin', s.b.ymin - s.dy, 'xmax', greatest(s.b.xmax, 180D), 'ymax', s.b.ymax + s.dy)
             ELSE named_struct('xmin', s.b.xmin - s.dx, 'ymin', s.b.ymin - s.dy, 'xmax', s.b.xmax + s.dx, 'ymax', s.b.ymax + s.dy) END), 1)"""),
    # The level whose cells, 2 to its power wide, a box covers at most five of along each side.
    f"geo_level(b {BOX})": ("int", "CAST(ceil(log2(greatest(b.xmax - b.xmin, b.ymax - b.ymin, 1e-9D))) AS INT) - 2"),
    # The cells of a box at its own level and at those of `levels` that are coarser; whether that is its own, and the column and row where it begins.
    f"geo_cells(b {BOX}, levels array<int>)": (
        "array<struct<own:int,level:int,cx:bigint,cy:bigint,first:boolean,left:boolean,low:boolean>>",
        """flatten(transform(transform(filter(array_union(array(geo_level(b)), levels), l -> l >= geo_level(b)), l -> named_struct('l', l, 'w', pow(2D, l))),
        s -> flatten(transform(sequence(floor(b.xmin / s.w), floor(b.xmax / s.w)), x -> transform(sequence(floor(b.ymin / s.w), floor(b.ymax / s.w)), y -> named_struct('own', geo_level(b), 'level', s.l, 'cx', x, 'cy', y, 'first', s.l = geo_level(b), 'left', x = floor(b.xmin / s.w), 'low', y = floor(b.ymin / s.w)))))))""",
    ),
}
_SQL_ARROW = {
    "st_intersects": st_intersects, "st_contains": st_contains, "st_touches": st_touches, "st_distance": st_distance, "st_dwithin": st_dwithin,
    "st_intersection": _intersection, "st_buffer": st_buffer, "st_closestpoint": st_closestpoint, "st_geomfromtext": st_geomfromtext, "st_astext": st_astext,
    "st_asgeojson": st_asgeojson, "st_isvalid": st_isvalid, "st_transform": st_transform, "st_union": st_union, "st_union_of": _union,
    "st_within": _arrow("boolean", lambda a, b: shapes.contains(b, a)),
    "st_area": _arrow("double", shapes.area_of), "st_length": _arrow("double", lambda g: shapes.length_of(g, "line")), "st_perimeter": _arrow("double", lambda g: shapes.length_of(g, "polygon")),
    "st_centroid": _arrow(GEOMETRY, shapes.centroid), "st_envelope": _arrow(GEOMETRY, shapes.envelope), "st_boundary": _arrow(GEOMETRY, shapes.boundary),
    "st_translate": _arrow(GEOMETRY, shapes.translate), "st_distancesphere": _arrow("double", shapes.distance_sphere), "st_distance_sphere": _arrow("double", shapes.distance_sphere),
}


def register(spark: SparkSession) -> None:
    """Makes the functions callable in SQL text of this session. Unknown st_ names stay errors."""
    for signature, (result, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    for name, function in _SQL_ARROW.items():
        spark.udf.register(name, function)
