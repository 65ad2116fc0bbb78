"""Spatial joins as equi-joins on grid cells with an exact test after.

Areas are dealt to the cells that their bounding boxes cover, points to theirs. Large areas use coarser grids (each
level doubles the cell), so an area covers at most a fixed number of cells; points are dealt once for each level that
occurs. Both sides are shuffled by cell into a set number of tasks and joined by sorting: pairs grow faster than bytes,
so neither file sizes (which would broadcast a side and leave the pairs to the few tasks that read the other) nor shuffled
sizes say how many tasks they need. No plan has a nested loop.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.geo import RADIUS, boxes_meet, core_radius, haversine, inside, is_box, planar, reach_radius, st_xmax, st_xmin, st_ymax, st_ymin
from meridian.materialize import materialized

#: Cells that an area covers along each side at most.
SPAN = 8
_LEVEL, _CX, _CY = "__level", "__cx", "__cy"


def level_of(width: Column, height: Column, cell: float) -> Column:
    ratio = F.greatest(width, height) / F.lit(cell * (SPAN - 1))
    return F.when(ratio > 1.0, F.ceil(F.log2(F.when(ratio > 1.0, ratio)))).otherwise(0).cast("int")


def _cell(c: Column, level: Column, cell: float) -> Column:
    return F.floor(c / (F.lit(cell) * F.pow(F.lit(2.0), level)))


def dealt_boxes(df: DataFrame, box: dict[str, Column], cell: float) -> DataFrame:
    """A row for each cell of a row's box; rows with a null or empty box go."""
    df = df.where(box["xmin"].isNotNull() & box["xmax"].isNotNull() & box["ymin"].isNotNull() & box["ymax"].isNotNull())
    df = df.withColumn(_LEVEL, level_of(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"], cell))
    level = F.col(_LEVEL)
    span = lambda a: F.sequence(_cell(box[a + "min"], level, cell), _cell(box[a + "max"], level, cell))
    return df.withColumn(_CX, F.explode(span("x"))).withColumn(_CY, F.explode(span("y")))


def met_in_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on cells in as many tasks as the pairs need; see above."""
    n = tasks(left.sparkSession)
    return left.repartition(n, *keys).hint("merge").join(right.repartition(n, *keys), keys)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def levels_in(dealt: DataFrame) -> list[int]:
    """The grid levels that occur: a few dozen at most, as each doubles the cell."""
    return sorted(r[0] for r in dealt.select(_LEVEL).distinct().collect())


def dealt_points(df: DataFrame, x: Column, y: Column, cell: float, levels: list[int]) -> DataFrame:
    df = df.where(x.isNotNull() & y.isNotNull()).withColumn(_LEVEL, F.explode(F.array(*map(F.lit, levels or [0]))))
    return df.withColumn(_CX, _cell(x, F.col(_LEVEL), cell)).withColumn(_CY, _cell(y, F.col(_LEVEL), cell))


def join_points(areas: DataFrame, points: DataFrame, box: dict[str, Column], x: Column, y: Column, test: Column, cell: float = 1.0, how: str = "inner") -> DataFrame:
    """Areas with the points that pass `test` (a condition on columns of both). Every pair is met in exactly one cell."""
    dealt = dealt_boxes(areas, box, cell)
    met = met_in_cells(dealt, dealt_points(points, x, y, cell, levels_in(dealt)), [_LEVEL, _CX, _CY]).where(test)
    if how == "semi":
        met = met.select(*areas.columns).distinct()
    return met.drop(_LEVEL, _CX, _CY)


def join_inside(areas: DataFrame, points: DataFrame, geometry: str, x: Column, y: Column, cell: float = 1.0) -> DataFrame:
    """Areas (polygons) with the points in their interior.

    What decides most pairs is worked out once an area: its box, whether it is one, and around the box's middle a circle
    that lies inside and one that holds all. Only points between the circles meet the edges."""
    g = F.col(geometry)
    sides = {n: F.col(f"__{n}") for n in ("xmin", "ymin", "xmax", "ymax")}
    boxed = areas.repartition(tasks(areas.sparkSession)).withColumns({"__xmin": st_xmin(g), "__ymin": st_ymin(g), "__xmax": st_xmax(g), "__ymax": st_ymax(g), "__is_box": is_box(g)})
    boxed = materialized(boxed)  # read twice; and the next columns' lambdas would work these out once an edge
    middle = [(sides[a + "min"] + sides[a + "max"]) / 2.0 for a in "xy"]
    boxed = boxed.withColumns({"__mx": middle[0], "__my": middle[1]})
    boxed = materialized(boxed.withColumns({"__core": F.when(~F.col("__is_box"), core_radius(g, F.col("__mx"), F.col("__my"))), "__reach": F.when(~F.col("__is_box"), reach_radius(g, F.col("__mx"), F.col("__my")))}))
    dx, dy = x - F.col("__mx"), y - F.col("__my")
    in_box = (x > sides["xmin"]) & (x < sides["xmax"]) & (y > sides["ymin"]) & (y < sides["ymax"])
    far, core, reach = dx * dx + dy * dy, F.col("__core"), F.col("__reach")
    # Two joins, so that the many pairs that are sure need not carry the shape if nothing after asks for it.
    sure = join_points(boxed, points, sides, x, y, in_box & (F.col("__is_box") | (far < core * core)), cell)
    near = join_points(boxed, points, sides, x, y, in_box & ~F.col("__is_box") & (far >= core * core) & (far <= reach * reach), cell)
    near = near.withColumn("__id", F.monotonically_increasing_id())  # keeps the edges' test out of the join, which it would slow down for all pairs
    met = sure.unionByName(near.where(inside(g, x, y)).drop("__id"))
    return met.drop(*(f"__{n}" for n in ("xmin", "ymin", "xmax", "ymax", "is_box", "mx", "my", "core", "reach")))


def join_boxes(a: DataFrame, b: DataFrame, box_a: dict[str, Column], box_b: dict[str, Column], test: Column | None = None, cell: float = 1.0) -> DataFrame:
    """Pairs whose boxes meet and that pass `test`. A pair counts in the cell of its overlap's lower left corner only.

    Both sides use one grid: the coarsest level that any area needs would crowd cells, so the finer side is dealt
    again at each coarser level that the other side has."""
    left, right = dealt_boxes(a, box_a, cell), dealt_boxes(b, box_b, cell)
    levels = sorted({*levels_in(left), *levels_in(right)})

    def at_levels(df: DataFrame, box: dict[str, Column], tag: str) -> DataFrame:
        """A row for each cell at each level, and whether the level and the cell's column and row are where its box begins."""
        own = df.withColumn("__own", level_of(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"], cell))
        own = own.withColumn(_LEVEL, F.explode(F.filter(F.array(*map(F.lit, levels or [0])), lambda v: v >= F.col("__own"))))
        span = lambda s: F.sequence(_cell(box[s + "min"], F.col(_LEVEL), cell), _cell(box[s + "max"], F.col(_LEVEL), cell))
        dealt = own.withColumn(_CX, F.explode(span("x"))).withColumn(_CY, F.explode(span("y")))
        begins = lambda s, c: _cell(box[s + "min"], F.col(_LEVEL), cell) == F.col(c)
        return dealt.withColumns({f"__l{tag}": F.col("__own") == F.col(_LEVEL), f"__x{tag}": begins("x", _CX), f"__y{tag}": begins("y", _CY)}).drop("__own")

    valid = lambda df, box: df.where(box["xmin"].isNotNull() & box["xmax"].isNotNull() & box["ymin"].isNotNull() & box["ymax"].isNotNull())
    x, y = at_levels(valid(a, box_a), box_a, "a"), at_levels(valid(b, box_b), box_b, "b")
    met = met_in_cells(x, y, [_LEVEL, _CX, _CY])
    for mark in "lxy":  # the coarser level of the two; the overlap begins where the later of the two boxes does
        met = met.where(F.col(f"__{mark}a") | F.col(f"__{mark}b"))
    met = met.where(boxes_meet(box_a, box_b))
    return (met.where(test) if test is not None else met).drop(_LEVEL, _CX, _CY, *(f"__{m}{t}" for m in "lxy" for t in "ab"))


def join_within(a: DataFrame, b: DataFrame, xy_a: tuple[Column, Column], xy_b: tuple[Column, Column], distance: float, geodetic: bool = False, name: str = "distance") -> DataFrame:
    """Pairs of points at most `distance` apart (metres, if geodetic), with that distance.

    Plane cells are as wide as the distance, so a point of b is dealt to its cell and the eight around it. Geodetic
    cells are bands of latitude as high as the distance, each cut into columns as wide as it needs in that band and the
    two beside it; columns go round the earth, so pairs across longitude 180 and near the poles are met too."""
    if geodetic:
        left, right = _banded(a, b, xy_a, xy_b, distance)
    else:
        place = lambda c: F.floor(c / F.lit(max(distance, 1e-12)))
        around = lambda c: F.array(*(place(c) + i for i in (-1, 0, 1)))
        left = a.withColumn(_CX, place(xy_a[0])).withColumn(_CY, place(xy_a[1]))
        right = b.withColumn(_CX, F.explode(around(xy_b[0]))).withColumn(_CY, F.explode(around(xy_b[1])))
    measure = (haversine if geodetic else planar)(*xy_a, *xy_b)
    high = distance / (math.pi * RADIUS / 180.0) * 1.000001 if geodetic else distance  # no pair is farther apart in y
    met = met_in_cells(left, right, [_CX, _CY]).where(F.abs(xy_a[1] - xy_b[1]) <= F.lit(high))
    return met.withColumn(name, measure).where(F.col(name) <= distance).drop(_CX, _CY)


def _banded(a: DataFrame, b: DataFrame, xy_a: tuple[Column, Column], xy_b: tuple[Column, Column], distance: float) -> tuple[DataFrame, DataFrame]:
    """a's points in their cells, b's in all cells that may hold a point within the distance."""
    high = max(distance / (math.pi * RADIUS / 180.0) * 1.000001, 1e-7)
    band = lambda y: F.floor(y / F.lit(high))

    def columns(of: Column) -> Column:
        """How many columns a band has."""
        far = F.greatest(F.abs(of - 1), F.abs(of + 2)) * F.lit(high)
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(high, 90.0)))) / F.cos(F.radians(F.least(far, F.lit(89.999999)))))))
        return F.when(far + high >= 90.0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.floor(360.0 / (wide * 1.000001)).cast("double"))).cast("long")

    column = lambda x, n: F.floor((x + 180.0 - 360.0 * F.floor((x + 180.0) / 360.0)) / (360.0 / n))
    left = a.withColumn(_CY, band(xy_a[1])).withColumn(_CX, column(xy_a[0], columns(F.col(_CY))))
    right = b.withColumn(_CY, F.explode(F.array(*(band(xy_b[1]) + i for i in (-1, 0, 1)))))
    n = columns(F.col(_CY))
    return left, right.withColumn(_CX, F.explode(F.array_distinct(F.array(*(F.pmod(column(xy_b[0], n) + i, n) for i in (-1, 0, 1))))))


def nearest(a: DataFrame, b: DataFrame, key: str, xy_a: tuple[Column, Column], xy_b: tuple[Column, Column], k: int, tie: list[str], cell: float, name: str = "distance", rounds: int = 120) -> DataFrame:
    """The k nearest points of b (plane distance) for each row of a; `key` tells a's rows apart, `tie` orders equal ones.

    A round looks at the cells within one cell of a point, then the cell doubles for the rows whose k-th distance is
    not yet within what has been looked at; rows that fewer than k points can serve end when one cell holds all. The
    first cell is `cell` wide, or as much smaller as leaves a few of b's points in it: a row looks at as many however
    large b is. Of b's points in one place the first k are enough."""
    place = lambda c, size: F.floor(c / F.lit(size))
    reach = [v for df, xy in ((a, xy_a), (b, xy_b)) for v in df.agg(*(F.max(F.abs(c)) for c in xy)).first()]
    widest = max([0.0, *(float(v) for v in reach if v is not None)])  # beyond it all points are in the four cells around the origin
    b = b.withColumn("__same", F.row_number().over(Window.partitionBy(*xy_b).orderBy(*tie))).where(F.col("__same") <= k).drop("__same")
    todo, out, size = a, None, _first_cell(b, xy_b, k, cell)
    for _ in range(rounds):
        right = b.withColumn(_CX, F.explode(F.array(*(place(xy_b[0], size) + i for i in (-1, 0, 1))))).withColumn(_CY, F.explode(F.array(*(place(xy_b[1], size) + i for i in (-1, 0, 1)))))
        met = met_in_cells(todo.withColumn(_CX, place(xy_a[0], size)).withColumn(_CY, place(xy_a[1], size)), right, [_CX, _CY]).drop(_CX, _CY)
        rank = F.row_number().over(Window.partitionBy(key).orderBy(name, *tie))
        best = met.withColumn(name, planar(*xy_a, *xy_b)).withColumn("rank", rank).where(F.col("rank") <= k)
        last = size > widest
        if last:
            return best if out is None else out.unionByName(best)
        best = materialized(best)
        sure = best.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(name).alias("__far")).where((F.col("__n") >= k) & (F.col("__far") <= size)).select(key)
        done = best.join(sure, key, "left_semi")
        out = done if out is None else out.unionByName(done)
        todo = materialized(todo.join(sure, key, "left_anti"))
        if todo.isEmpty():
            return out
        size *= 2
    raise RuntimeError("the grid did not come to cover the points")


#: Points that a point shares the first cell with, at most on average, for each neighbour wanted; halvings of the cell.
CROWD, HALVINGS = 2, 24


def _first_cell(b: DataFrame, xy: tuple[Column, Column], k: int, cell: float) -> float:
    """`cell`, halved until b's points have few others in theirs."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(HALVINGS)), lambda i: F.struct(i.alias("i"), (F.lit(cell) / F.pow(F.lit(2.0), i)).alias("size")))
    dealt = b.select(xy[0].alias("x"), xy[1].alias("y"), F.explode(sizes).alias("s")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = dealt.groupBy("s.i", F.floor(F.col("x") / F.col("s.size")).alias("cx"), F.floor(F.col("y") / F.col("s.size")).alias("cy")).count()
    crowds = cells.groupBy("i").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("crowd")).collect()
    halvings = min((r["i"] for r in crowds if r["crowd"] <= CROWD * k), default=HALVINGS if crowds else 0)
    return cell / 2.0**halvings


def extent(df: DataFrame, keys: list[str], box: Callable[[str], Column]) -> DataFrame:
    """The bounding box of each group: an aggregate with partial sums like any minimum."""
    return df.groupBy(*keys).agg(*(getattr(F, n[1:])(box(n)).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))
