"""Validity of geometries as a table of defects.

Each check is a query over exploded coordinates or over the self-join of a geometry's own
segments; codes are listed in order of precedence. Rings of one polygon, and polygons of one
multi-polygon, are checked against each other through the noded sub-segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terrazzo.functions.geometry import LINE, POINT, POLYGON
from terrazzo.functions.kernels import LANES
from terrazzo.operators import model, noding
from terrazzo.session import materialize

#: Codes in order of precedence.
CODES = (
    "invalid_coordinate", "ring_not_closed", "too_few_points", "self_intersection", "ring_self_intersection",
    "hole_outside_shell", "nested_holes", "nested_shells", "disconnected_interior",
)


def _units(geoms: DataFrame) -> DataFrame:
    """(id, elem) -> unit: the polygons of one multi-polygon are one unit, every child of a collection its own."""
    rows = geoms.select("id", F.col("geom.type").alias("type"), F.posexplode("geom.elements").alias("elem", "e"))
    parent = F.when(F.col("type") == "MultiPolygon", F.lit("0")).otherwise(F.concat_ws("/", F.lit("e"), F.col("elem").cast("string")))
    return rows.where(F.col("e.kind") == POLYGON).select("id", "elem", parent.alias("unit"))


def shape_defects(coords: DataFrame) -> DataFrame:
    """(id, elem, ring, code) of coordinates, closure and size; coords: id, elem, kind, ring, i, x, y."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    w = Window.partitionBy("id", "elem", "ring").orderBy("i")
    new = F.coalesce((F.col("x") != F.lag("x").over(w)) | (F.col("y") != F.lag("y").over(w)), F.lit(True))
    rows = coords.withColumn("_new", new.cast("int"))
    per = rows.groupBy("id", "elem", "kind", "ring").agg(
        F.bool_or(bad("x") | bad("y")).alias("nonfinite"), F.sum("_new").alias("n"), F.min(F.struct("i", "x", "y")).alias("s"), F.max(F.struct("i", "x", "y")).alias("e")
    )
    open_ = (F.col("s.x") != F.col("e.x")) | (F.col("s.y") != F.col("e.y"))
    code = F.when(F.col("nonfinite"), CODES[0]).when((F.col("kind") == POLYGON) & open_, CODES[1])
    code = code.when((F.col("kind") == POLYGON) & (F.col("n") < 4) | (F.col("kind") == LINE) & (F.col("n") < 2), CODES[2])
    return per.where(F.col("kind") != POINT).unionByName(per.where((F.col("kind") == POINT) & F.col("nonfinite"))).withColumn("code", code).where("code IS NOT NULL").select("id", "elem", "ring", "code")


def _crossings(segs: DataFrame, units: DataFrame, lane) -> DataFrame:
    """(id, unit, code) of segments of one unit that cross, overlap, or touch where one ring meets itself."""
    own = segs.join(units, ["id", "elem"]).select(F.struct("id", "unit").alias("pair"), "g", "elem", "kind", "ring", "i", "x1", "y1", "x2", "y2")
    ordinates = [F.col(f"{p}{c}") for p in "st" for c in ("x1", "y1", "x2", "y2")]
    met = noding.candidate_pairs(own, lane).withColumn("p", lane.crossings(*ordinates)).where(F.size("p") > 0)
    end = lambda s, k: lane.point(F.col(f"{s}x{k}"), F.col(f"{s}y{k}"))
    p = F.get("p", F.lit(0))
    inner = lambda s: (p != end(s, 1)) & (p != end(s, 2))
    same_ring = (F.col("s.elem") == F.col("t.elem")) & (F.col("s.ring") == F.col("t.ring"))
    follows = same_ring & (end("s", 2) == end("t", 1)) & (F.col("t.i") == F.col("s.i") + 1)
    closes = same_ring & (end("t", 2) == end("s", 1)) & (F.col("s.i") == 0)
    code = F.when(F.size("p") > 1, CODES[3]).when(inner("s") & inner("t"), CODES[3]).when(same_ring & ~follows & ~closes, CODES[4])
    return met.withColumn("code", code).where("code IS NOT NULL").select("pair.id", "pair.unit", "code").distinct()


def _ring_relations(segs: DataFrame, units: DataFrame, lane) -> DataFrame:
    """(id, unit, r, q, inside, outside): whether parts of ring r lie strictly inside or outside ring q of the same unit."""
    rings = segs.join(units, ["id", "elem"])
    pieces, _ = noding.split(rings.select(F.struct("id", "unit").alias("pair"), "g", "elem", "kind", "ring", "i", "x1", "y1", "x2", "y2"), rings.select(F.struct("id", "unit").alias("pair"), F.col("x1").alias("x"), F.col("y1").alias("y")).where("false"), lane)
    m = pieces.select("pair", F.struct("elem", "ring").alias("r"), F.struct("u", "v").alias("at"), "u", "v", lane.level(F.col("u"), F.col("v")).alias("level"))
    edges = rings.select(F.struct("id", "unit").alias("pair"), F.struct("elem", "ring").alias("q"), "x1", "y1", "x2", "y2")
    hit = m.join(edges, "pair").where(F.col("r") != F.col("q")).withColumn("h", lane.beside(F.col("u"), F.col("v"), F.col("level"), *(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    per = hit.groupBy("pair", "r", "q", "at").agg((F.sum(F.col("h.plus").cast("int")) % 2 == 1).alias("inside"), F.bool_or("h.on").alias("on"))
    out = per.groupBy("pair", "r", "q").agg(F.bool_or(F.col("inside") & ~F.col("on")).alias("inside"), F.bool_or(~F.col("inside") & ~F.col("on")).alias("outside"))
    return out.select("pair.id", "pair.unit", "r", "q", "inside", "outside")


def _nesting(relations: DataFrame) -> DataFrame:
    """(id, unit, code) of holes outside their shell, holes in holes and shells in shells."""
    own = F.col("r.elem") == F.col("q.elem")
    hole, of_shell = F.col("r.ring") > 0, F.col("q.ring") == 0
    code = F.when(own & hole & of_shell & F.col("outside"), CODES[5]).when(own & hole & (F.col("q.ring") > 0) & F.col("inside") & ~F.col("outside"), CODES[6])
    shells = ~own & (F.col("r.ring") == 0) & of_shell & F.col("inside") & ~F.col("outside")
    held = relations.where((F.col("r.ring") == 0) & (F.col("q.ring") > 0) & (F.col("r.elem") != F.col("q.elem")) & ~F.col("outside")).select("id", "unit", "r", F.col("q.elem").alias("host")).distinct()
    found = relations.withColumn("code", code.when(shells, CODES[7])).where("code IS NOT NULL")
    # a shell that lies in a hole of the other polygon is no defect
    excused = found.join(held.withColumn("_ok", F.lit(True)), [found["id"] == held["id"], found["unit"] == held["unit"], found["r"] == held["r"], found["q.elem"] == held["host"]], "left").where("NOT (code = 'nested_shells' AND coalesce(_ok, false))")
    return excused.select(found["id"], found["unit"], "code").distinct()


def _touch_cycles(segs: DataFrame, units: DataFrame, lane) -> DataFrame:
    """(id, unit, code): rings of one polygon that touch in a cycle cut its interior.

    In the graph of a polygon's rings and the points where two or more of them meet, a component with
    as many links as nodes holds a cycle; components are found by spreading the least ring along links.
    """
    own = segs.join(units, ["id", "elem"]).select(F.struct("id", "elem").alias("pair"), "unit", "g", "elem", "kind", "ring", "i", "x1", "y1", "x2", "y2")
    met = noding.candidate_pairs(own, lane).where(F.col("s.ring") != F.col("t.ring"))
    met = met.withColumn("p", F.explode(lane.crossings(*(F.col(f"{p}{c}") for p in "st" for c in ("x1", "y1", "x2", "y2")))))
    links = met.select("pair", "p", F.explode(F.array("s.ring", "t.ring")).alias("ring")).distinct()
    links = materialize(links, "touches")
    rings = links.select("pair", "ring").distinct().withColumn("root", F.col("ring"))
    while True:
        by_point = links.join(rings, ["pair", "ring"]).groupBy("pair", "p").agg(F.min("root").alias("m"))
        after = links.join(by_point, ["pair", "p"]).groupBy("pair", "ring").agg(F.min("m").alias("m"))
        moved = materialize(rings.join(after, ["pair", "ring"]).select("pair", "ring", F.least("root", "m").alias("root"), (F.col("m") < F.col("root")).alias("moved")), "roots")
        rings = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    size = links.join(rings, ["pair", "ring"]).groupBy("pair", "root").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("p").alias("points"), F.count_distinct("ring").alias("rings"))
    bad = size.where("links >= points + rings").select("pair.id", "pair.elem").distinct()
    return bad.join(units, ["id", "elem"]).select("id", "unit", F.lit(CODES[8]).alias("code")).distinct()


def defects(geoms: DataFrame, lane: str | None = None) -> DataFrame:
    """(id, code): the distinct defects of geometries (id, geom); deeper checks run where shapes are sound."""
    if lane is None:
        return noding.on_either_lane(geoms, defects, "geom")
    k = LANES[lane]
    pairs = geoms.select(F.col("id").alias("pair"), F.col("geom").alias("a"), F.lit(None).cast(geoms.schema["geom"].dataType).alias("b"))
    coords = model.coordinates(pairs).where("g = 0")
    flat = coords.withColumnRenamed("pair", "id")
    shape = materialize(shape_defects(flat).select("id", "code").distinct(), "shape-defects")
    sound = coords.join(shape.select(F.col("id").alias("pair")).distinct(), "pair", "left_anti")
    segs = materialize(model.segments(model.on_grid(sound.where(F.col("kind") == POLYGON), k)).withColumnRenamed("pair", "id"), "rings")
    units = _units(geoms)
    crossing = materialize(_crossings(segs, units, k), "crossings")
    out = shape.unionByName(crossing.select("id", "code"))
    # rings are checked against each other only where there are several
    rings = F.aggregate(F.filter("geom.elements", lambda e: e["kind"] == POLYGON), F.lit(0), lambda n, e: n + F.size(e["rings"]))
    several = geoms.where(rings > 1).select("id")
    if several.isEmpty():
        return out.distinct()
    clean = segs.join(several, "id", "left_semi").join(crossing.select("id").distinct(), "id", "left_anti")
    nested = _nesting(_ring_relations(clean, units, k))
    cycles = _touch_cycles(clean, units, k)
    return out.unionByName(nested.select("id", "code")).unionByName(cycles.select("id", "code")).distinct()


def validate(geoms: DataFrame, lane: str | None = None) -> DataFrame:
    """(id, valid, reasons): codes in order of precedence."""
    order = F.array(*map(F.lit, CODES))
    found = defects(geoms, lane).groupBy("id").agg(F.sort_array(F.collect_set(F.struct(F.array_position(order, F.col("code")).alias("k"), "code"))).alias("r"))
    rows = geoms.select("id").join(found, "id", "left")
    reasons = F.coalesce(F.transform("r", lambda x: x["code"]), F.array().cast("array<string>"))
    return rows.select("id", F.col("r").isNull().alias("valid"), reasons.alias("reasons"))
