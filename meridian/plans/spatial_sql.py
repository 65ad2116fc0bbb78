"""Spatial conditions of SQL text as equi-joins on grid cells.

An inner join of two relations on ST_Contains, ST_Within, ST_Intersects, ST_Touches or ST_DWithin would be planned as a
nested loop. Here each of the two relations gets the bounding box of its geometry (widened by the distance for
ST_DWithin) and a row for each grid cell that the box covers; the join compares cells, and the condition itself stays as
the exact test after it. Cells double from level to level. A box is dealt at the level that fits its size, where it
covers at most 25 cells, and at the other relation's coarser levels, which a scalar subquery lists; two boxes meet at the
coarser of their two levels, in the cell of their overlap's lower left corner, so every pair comes once.

Points and boxes along the axes are marked before the join, and pairs of them are tested in it; the condition in Python
gets nulls for these. Both relations are shuffled by cell into a set number of tasks and joined by sorting: small files
would make it a broadcast, with all pairs in the few tasks that read the other relation.

Left as they are: conditions whose two geometries do not each come from one named relation of the same FROM, outer
joins, lateral relations.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from meridian.functions.geo import RADIUS
from meridian.operators.spatial import tasks
from meridian.plans.sql_compare import text
from meridian.plans.sql_tree import Node

JOINED = ("st_contains", "st_within", "st_intersects", "st_touches", "st_dwithin")


def _raw(sql: str) -> Node:
    return Node("Literal", sql)


def _name(relation: Node) -> str | None:
    """What columns call a relation by; None for relations that cannot be wrapped."""
    body = relation.kids[0] if relation.kind == "TableAlias" else relation
    if body.kind not in ("Table", "Subquery"):
        return None
    return relation.kids[1].value if relation.kind == "TableAlias" else body.kids[-1].value if body.kind == "Table" else None


def _source(n: Node) -> str | None:
    """The one relation that all columns of an expression name, else None."""
    names = {x.kids[0].value.lower() if len(x.kids) == 2 else "" for x in n.walk() if x.kind in ("Column", "Star")}
    plain = not any(x.kind in ("Subquery", "Exists", "Window") for x in n.walk())
    return next(iter(names)) if plain and len(names) == 1 and "" not in names else None


def _conjuncts(n: Node) -> list[Node]:
    return [y for x in n.kids for y in _conjuncts(x)] if n.kind == "And" else [n]


def with_grids(select: Node) -> Node:
    """A select of Spark SQL, its spatial inner joins on cells."""
    joins, relations = select.clauses.get("joins", []), {}
    if any(j.value.split()[:1] and j.value.split()[0] in ("right", "full") or "natural" in j.value for j in joins):
        return select
    places = [(select.clauses["from"], i) for i in range(len(select.clauses.get("from", [])))]
    places += [(j.kids, 0) for j in joins if j.value in ("", "inner", ",", "cross")]
    for holder, i in places:
        if name := _name(holder[i]):
            relations.setdefault(name.lower(), []).append((holder, i))
    relations = {k: v[0] for k, v in relations.items() if len(v) == 1}
    conditions = [(j.kids, 1) for j in joins if j.value in ("", "inner") and len(j.kids) > 1 and j.kids[1].kind != "Using"]
    conditions += [(select.clauses["where"], i) for i in range(len(select.clauses.get("where", [])))]
    hidden: dict[str, list[str]] = {}
    n = 0
    originals = {k: text(holder[i]) for k, (holder, i) in relations.items()}
    for holder, i in conditions:
        out = []
        for c in _conjuncts(holder[i]):
            sides = [_source(x) for x in c.kids[:2]] if c.kind == "Function" and c.value in JOINED and len(c.kids) >= 2 else []
            far = c.kids[2] if len(c.kids) > 2 else None
            near = c.value != "st_dwithin" or far is not None and not any(x.kind in ("Column", "Subquery") for x in far.walk())
            if len(sides) == 2 and sides[0] != sides[1] and all(s in relations for s in sides) and near:
                out += _celled(c, sides, relations, originals, hidden, n, text(far) if c.value == "st_dwithin" else None)
                n += 1
            else:
                out.append(c)
        if len(out) > 1:
            holder[i] = Node("And", kids=out)
    if hidden:
        merged = [text(holder[i].kids[1]) for holder, i in (relations[s] for s in hidden)]
        select.clauses["select"] = [_without(item, hidden, relations) for item in select.clauses["select"]]
        if not select.clauses.get("distinct"):
            select.clauses["select"][0] = _raw(f"/*+ MERGE({', '.join(merged)}) */ {text(select.clauses['select'][0])}")
    return select


def _tasks() -> int:
    spark = SparkSession.getActiveSession()
    return tasks(spark) if spark else 200


def _sure(c: Node, p: str, q: str, far: str | None) -> tuple[str, str]:
    """When the shapes p and q of a condition's two sides decide it, and what they decide; their boxes meet."""
    known = f"{p}.t > 0 AND {q}.t > 0 AND {p}.srid = {q}.srid"
    if c.value == "st_intersects":
        return known, "true"
    if c.value in ("st_contains", "st_within"):
        a, b = (p, q) if c.value == "st_contains" else (q, p)
        inside = " AND ".join(f"{b}.{k}min > {a}.{k}min AND {b}.{k}max < {a}.{k}max" for k in "xy")
        covers = " AND ".join(f"{b}.{k}min >= {a}.{k}min AND {b}.{k}max <= {a}.{k}max" for k in "xy")
        return known, f"CASE WHEN {a}.t = 2 AND {b}.t = 1 THEN {inside} ELSE {covers} END"
    if c.value == "st_touches":
        open_ = " AND ".join(f"{p}.{k}min < {q}.{k}max AND {q}.{k}min < {p}.{k}max" for k in "xy")
        return known, f"({p}.t = 2 OR {q}.t = 2) AND NOT ({open_})"
    d = f"CAST({far} AS DOUBLE)"
    gap = lambda k: f"greatest({p}.{k}min - {q}.{k}max, {q}.{k}min - {p}.{k}max, 0D)"
    plane = f"sqrt({gap('x')} * {gap('x')} + {gap('y')} * {gap('y')}) <= {d}"
    half = lambda k: f"sin((radians({q}.{k}min) - radians({p}.{k}min)) / 2)"
    arc = f"{2 * RADIUS}D * asin(least(1D, sqrt({half('y')} * {half('y')} + cos(radians({p}.ymin)) * cos(radians({q}.ymin)) * {half('x')} * {half('x')}))) <= {d}"
    geodetic = f"({p}.geodetic AND {q}.geodetic)"
    return f"{known} AND (NOT {geodetic} OR {p}.t = 1 AND {q}.t = 1)", f"CASE WHEN {geodetic} THEN {arc} ELSE {plane} END"


def _celled(c: Node, sides: list[str], relations: dict, originals: dict, hidden: dict, n: int, far: str | None) -> list[Node]:
    boxes = [f"geo_box_within({text(c.kids[0])}, CAST({far} AS DOUBLE))" if far else f"geo_box({text(c.kids[0])})", f"geo_box({text(c.kids[1])})"]
    sizes = _tasks()
    for tag, s, box, other, its, own in zip((f"{n}a", f"{n}b"), sides, boxes, sides[::-1], boxes[::-1], c.kids, strict=False):
        holder, i = relations[s]
        alias = text(holder[i].kids[1] if holder[i].kind == "TableAlias" else holder[i].kids[-1])
        levels = f"(SELECT collect_set(l) FROM (SELECT geo_level(b) AS l FROM (SELECT explode(array(b)) AS b FROM (SELECT {its} AS b FROM {originals[other]})) WHERE b.xmin IS NOT NULL))"
        # explode: else the optimizer writes the box's own text into every lambda that uses it, which then works it out for each cell
        once = f"SELECT {alias}.*, named_struct('box', {box}, 'shape', geo_shape({text(own)})) AS __both{tag} FROM {text(holder[i])}"
        once = f"SELECT * EXCEPT (__both{tag}), explode(array(__both{tag})) AS __once{tag} FROM ({once})"
        boxed = f"SELECT * EXCEPT (__once{tag}), __once{tag}.box AS __box{tag}, __once{tag}.shape AS __shape{tag} FROM ({once})"
        dealt = f"SELECT *, geo_cells(__box{tag}, __levels{tag}) AS __cells{tag} FROM (SELECT *, {levels} AS __levels{tag} FROM ({boxed}) WHERE __box{tag}.xmin IS NOT NULL)"
        celled = f"SELECT * EXCEPT (__levels{tag}, __cells{tag}), explode(__cells{tag}) AS __cell{tag} FROM ({dealt})"
        body = f"(SELECT /*+ REPARTITION({sizes}, __cell{tag}.level, __cell{tag}.cx, __cell{tag}.cy) */ * FROM ({celled}))"
        holder[i] = Node("TableAlias", kids=[_raw(body), Node("Identifier", alias)])
        hidden.setdefault(s, []).extend(f"{x}{tag}" for x in ("__box", "__shape", "__cell"))
    a, b = (text(relations[s][0][relations[s][1]].kids[1]) for s in sides)
    p, q = f"{a}.__cell{n}a", f"{b}.__cell{n}b"
    x, y = f"{a}.__box{n}a", f"{b}.__box{n}b"
    meet = [f"{x}.{k}min <= {y}.{k}max AND {y}.{k}min <= {x}.{k}max" for k in ("x", "y")]
    begin = [f"({p}.{k} OR {q}.{k})" for k in ("first", "left", "low")]  # the coarser level; the overlap begins where the later of two boxes does
    sure, holds = _sure(c, f"{a}.__shape{n}a", f"{b}.__shape{n}b", far)
    sure = f"coalesce({sure}, false)"
    args = [f"CASE WHEN NOT {sure} THEN {text(k)} END" for k in c.kids[:2]] + [text(k) for k in c.kids[2:]]
    tests = [f"CASE WHEN {sure} THEN {holds} ELSE true END", f"coalesce({c.value}({', '.join(args)}), {sure})"]
    return [_raw(s) for s in (f"{p}.level = {q}.level", f"{p}.cx = {q}.cx", f"{p}.cy = {q}.cy", *begin, *meet, *tests)]


def _without(item: Node, hidden: dict, relations: dict) -> Node:
    """A star of a select list without the columns that this module adds."""
    if item.kind != "Star":
        return item
    if not item.kids:
        return _raw(f"* EXCEPT ({', '.join(c for names in hidden.values() for c in names)})")
    name = item.kids[-1].value.lower()
    return _raw(f"{text(item)} EXCEPT ({', '.join(hidden[name])})") if name in hidden else item
