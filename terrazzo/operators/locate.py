"""Where exact points lie relative to geometries: interior, boundary or exterior, and the dimension that decides.

Points are homogeneous points of a lane, keyed like the segments they are located in. Polygons decide first: a
point inside any polygon element is interior, one on the boundary of a single element is on the boundary. On
the boundaries of several it is interior exactly if some element covers each of the sectors that the edges through it
cut out of its neighbourhood. An element's state just above the direction of the positive x axis is the parity of a
ray; going round counter-clockwise it changes at each of the element's edges that leave the point. Then lines: odd
ends are boundary (Mod-2 rule), all else on a line is interior. Then point elements.

Nothing here uses labels or the noding of ``noding.arrange``.
"""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from terrazzo.functions.kernels import BITS, LANES
from terrazzo.operators import model
from terrazzo.operators.model import LINE, POINT, POLYGON
from terrazzo.operators.noding import ray_hits
from terrazzo.session import materialize


def _turn(p: tuple[int, int], q: tuple[int, int]) -> int:
    """Order of two directions by angle, from just above the positive x axis to that axis itself."""
    half = lambda d: 0 if d[1] > 0 or (d[1] == 0 and d[0] < 0) else 1
    if half(p) != half(q):
        return half(p) - half(q)
    cross = p[0] * q[1] - p[1] * q[0]
    return -1 if cross > 0 else 1 if cross < 0 else 0


def covered_all_round(rays: list[tuple[int, int, int]], inside: set[int]) -> bool:
    """Whether elements cover every sector around a point: rays (element, dx, dy) of their edges, the elements inside which the first sector lies."""
    inside = set(inside)
    if not inside:
        return False
    ordered = sorted(rays, key=cmp_to_key(lambda a, b: _turn(a[1:], b[1:])))
    for k, (element, dx, dy) in enumerate(ordered):
        inside ^= {element}
        last = k + 1 == len(ordered) or _turn((dx, dy), ordered[k + 1][1:])
        if last and not inside:
            return False
    return True


@F.pandas_udf(T.BooleanType())
def _covered(rays: pd.Series, inside: pd.Series) -> pd.Series:
    return pd.Series([covered_all_round([(r["elem"], int(r["dx"]), int(r["dy"])) for r in some], set(e)) for some, e in zip(rays, inside)], dtype=bool)


@F.pandas_udf(T.StructType([T.StructField("dx", T.StringType()), T.StructField("dy", T.StringType())]))
def _way(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
    """The vector from the first to the second of two points of integers of any size."""
    return pd.DataFrame([(str(int(c) - int(a)), str(int(d) - int(b))) for a, b, c, d in zip(x1, y1, x2, y2)], columns=["dx", "dy"])


_ENDS = ("x1", "y1", "x2", "y2")


def on_edges(points: DataFrame, segs: DataFrame, lane) -> DataFrame:
    """The columns of points (pair, id, p) and of the segments of their pair that hold them: by slab and box, then exactly."""
    points = points.join(segs.select("pair", *model.SLABS).distinct(), "pair")
    part = lambda k: F.col(f"p.{k}").cast("double") / F.col("p.W").cast("double")
    points = points.withColumns({"_x": part("X"), "_y": part("Y")}).withColumn("_slab", model.slab(F.col("_y")))
    slack = F.col("_big") * 2.0**-44
    of = lambda f, k: f(F.col(f"{k}1").cast("double"), F.col(f"{k}2").cast("double"))
    edges = segs.withColumn("_slab", F.explode(F.sequence(model.slab(of(F.least, "y") - slack), model.slab(of(F.greatest, "y") + slack)))).drop(*model.SLABS)
    in_box = F.lit(True)
    for k in "xy":
        in_box = in_box & (F.col(f"_{k}") >= of(F.least, k) - slack) & (F.col(f"_{k}") <= of(F.greatest, k) + slack)
    on = lane.beside(F.col("p"), F.col("p"), F.lit(False), *(F.col(c) for c in _ENDS))["on"]
    return points.join(edges, ["pair", "_slab"]).where(in_box | ~(F.col("_big") < model.FILTERED)).where(on).drop("_x", "_y", "_slab", *model.SLABS)


def located(points: DataFrame, coords: DataFrame, lane, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(pair, id, g, loc, dim): points (pair, id, p) relative to each side g of their pair's coordinates, on the grid of the lane."""
    keys = ["pair", "id", "g"]
    # what no geometry has is not joined to the points
    held_ = coords.groupBy("kind").agg(F.max("elem").alias("elem")).collect()
    kinds, several = {r.kind for r in held_}, any(r.kind == POLYGON and r.elem for r in held_)
    segs = model.with_slabs(model.segments(coords), ("x1", "y1"), ("x2", "y2"))
    rows = points.select("pair", "id", F.explode(F.array(*map(F.lit, sides))).alias("g"))
    if POLYGON in kinds:
        rows = rows.join(_areas(points, segs, lane, several).hint("merge"), keys, "left")
    else:
        rows = rows.withColumn("area", F.lit(None).cast("string"))
    if LINE in kinds:
        lines = on_edges(points, segs.where(F.col("kind") == LINE), lane).select(*keys).distinct().withColumn("line", F.lit(True))
        rows = rows.join(lines.hint("merge"), keys, "left")
    if LINE in kinds or POINT in kinds:
        pt = lane.point(F.col("x"), F.col("y")).alias("p")
        own = coords.where(F.col("kind") == POINT).select("pair", "g", pt, F.lit("dot").alias("part"))
        flat = coords.where(F.col("kind") == LINE).groupBy("pair", "g", "elem").agg(F.count_distinct("x", "y").alias("n"), F.min("x").alias("x"), F.min("y").alias("y")).where("n = 1")
        own = own.unionByName(flat.select("pair", "g", pt, F.lit("flat").alias("part")))
        own = own.unionByName(model.line_ends(coords, lane).where("odd").select("pair", "g", F.col("pt").alias("p"), F.lit("end").alias("part")))
        met = points.join(own, ["pair", "p"]).groupBy(*keys).agg(*(F.bool_or(F.col("part") == k).alias(k) for k in ("dot", "flat", "end")))
        rows = rows.join(met.hint("merge"), keys, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    is_line = yes("line") | yes("flat") | yes("end")
    loc = F.coalesce("area", F.when(yes("end"), "B").when(is_line | yes("dot"), "I").otherwise("E"))
    dim = F.when(F.col("area").isNotNull(), 2).when(is_line, 1).when(yes("dot"), 0).otherwise(-1)
    return rows.select(*keys, loc.alias("loc"), dim.alias("dim"))


def _areas(points: DataFrame, segs: DataFrame, lane, several: bool) -> DataFrame:
    """(pair, id, g, area): I or B of points in polygons; ``several``: whether a geometry has more than one."""
    keys = ["pair", "id", "g"]
    probes = points.select("pair", "id", F.col("p").alias("u"), F.col("p").alias("v"), F.lit(False).alias("level"))
    hits = ray_hits(probes, segs, lane).groupBy(*keys, "elem").agg((F.sum(F.col("plus").cast("int")) % 2 == 1).alias("plus"), F.bool_or("on").alias("on"))
    hits = materialize(hits, "ray-hits").hint("merge")  # as many as points: not for the driver to send, however small their files
    areas = hits.groupBy(*keys).agg(F.bool_or(F.col("plus") & ~F.col("on")).alias("inside"), F.count_if("on").alias("rims"))
    areas = _with_shared(areas, hits, points, segs, lane) if several else areas.withColumn("covered", F.lit(False))
    return areas.select(*keys, F.when(F.col("inside") | F.coalesce("covered", F.lit(False)), "I").when(F.col("rims") > 0, "B").alias("area"))


def _with_shared(areas: DataFrame, hits: DataFrame, points: DataFrame, segs: DataFrame, lane) -> DataFrame:
    """``areas`` with covered: whether the elements on whose boundaries a point lies cover all around it, by the directions of the edges that leave it."""
    keys = ["pair", "id", "g"]
    shared = areas.where("NOT inside AND rims > 1").select(*keys)
    held = on_edges(points.join(shared.select("pair", "id").distinct(), ["pair", "id"], "left_semi"), segs.where(F.col("kind") == POLYGON), lane)
    end = lambda n: lane.point(F.col(f"x{n}"), F.col(f"y{n}"))
    held = held.withColumn("d", _way(*(F.col(c).cast("string") for c in _ENDS)))
    back = lambda c: F.when(F.col(c).startswith("-"), F.substr(F.col(c), F.lit(2))).when(F.col(c) == "0", "0").otherwise(F.concat(F.lit("-"), F.col(c)))
    leaves = F.array_compact(F.array(
        F.when(F.col("p") != end(2), F.struct("elem", F.col("d.dx").alias("dx"), F.col("d.dy").alias("dy"))), F.when(F.col("p") != end(1), F.struct("elem", back("d.dx").alias("dx"), back("d.dy").alias("dy"))),
    ))
    rays = held.groupBy(*keys).agg(F.flatten(F.collect_list(leaves)).alias("rays"))  # of one point
    first = hits.where("plus").groupBy(*keys).agg(F.collect_set("elem").alias("first"))
    covered = shared.join(rays, keys).join(first, keys, "left")
    covered = covered.select(*keys, _covered("rays", F.coalesce("first", F.array().cast("array<int>"))).alias("covered"))
    return areas.join(covered.hint("merge"), keys, "left")


def locate(points: DataFrame, geoms: DataFrame) -> DataFrame:
    """(key, id, loc, dim): points (key, id, x, y as doubles; ids differ within a key) relative to the geometry of their key (key, geom).

    loc is I, B or E, dim the dimension of the part that decides, -1 outside. Points whose key has no geometry are left out; an
    empty or null geometry has them all outside.
    """
    small = lambda c: (F.abs(F.col(c)) < float(1 << BITS)) & (F.col(c) == F.floor(c))
    fits = points.groupBy("key").agg(F.bool_and(small("x") & small("y")).alias("_points"))
    fits = geoms.select("key", F.coalesce(model.is_grid_integer(F.col("geom")), F.lit(True)).alias("_geom")).join(fits, "key")
    fits = materialize(fits.select(F.col("key").alias("pair"), (F.col("_points") & F.col("_geom")).alias("narrow")), "lanes")
    sided = geoms.select(F.col("key").alias("pair"), F.col("geom").alias("a"), F.lit(None).cast(geoms.schema["geom"].dataType).alias("b"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = model.coordinates(sided).withColumn("id", none(points.schema["id"].dataType))
    rows = rows.unionByName(points.select(
        F.col("key").alias("pair"), F.lit(-1).alias("g"), F.lit(-1).alias("elem"), F.lit(POINT).alias("kind"), F.lit(0).alias("ring"), F.lit(0).alias("i"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), none("double").alias("x2"), none("double").alias("y2"), "id",
    ))
    out = None
    for narrow in (r.narrow for r in fits.select("narrow").distinct().collect()):
        lane = LANES["narrow" if narrow else "wide"]
        own = materialize(model.on_grid(rows.join(fits.where(F.col("narrow") == narrow).select("pair"), "pair", "left_semi"), lane), "located").hint("merge")
        found = located(own.where("g < 0").select("pair", "id", lane.point(F.col("x"), F.col("y")).alias("p")), own.where("g >= 0").drop("id"), lane, (0,))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return points.where("false").select("key", "id", F.lit("E").alias("loc"), F.lit(-1).alias("dim"))
    return out.select(F.col("pair").alias("key"), "id", "loc", "dim")
