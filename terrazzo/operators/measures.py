"""Measures of geometries: area, length, centroid, hull, distance and nearest points, all exact or certified.

Tables hold (id, geom) or pairs (pair, a, b). Coordinates are exploded and grouped; a group holds the
coordinates of one geometry. Small Arrow helpers add rationals and bound roots.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from terrazzo.functions.exact import ENCLOSURE, format_rational, rational_min, rational_sum, root_weighted_mean, sqrt_sum, to_rational
from terrazzo.functions.geometry import LINE, POINT, POLYGON
from terrazzo.functions.kernels import LANES
from terrazzo.operators import model
from terrazzo.operators.noding import candidate_pairs, covers, on_either_lane
from terrazzo.session import materialize


def coordinates(geoms: DataFrame) -> DataFrame:
    """id, elem, kind, ring, i, x, y."""
    rows = geoms.select("id", F.posexplode("geom.elements").alias("elem", "_e"))
    rows = rows.select("id", "elem", "_e.kind", F.posexplode("_e.rings").alias("ring", "_r"))
    return rows.select("id", "elem", "kind", "ring", F.posexplode("_r").alias("i", "_p")).select("id", "elem", "kind", "ring", "i", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def _beside(rows: DataFrame, *others: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with the columns of tables by id. As many rows as geometries: never sent whole to the driver, however small their files make them seem."""
    for other in others:
        rows = rows.join(other.hint("merge"), "id", how)
    return rows


def _steps(coords: DataFrame) -> DataFrame:
    w = Window.partitionBy("id", "elem", "ring").orderBy("i")
    return coords.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 IS NOT NULL")


_TERMS = T.StructType([T.StructField(k, T.StringType()) for k in ("c", "cx", "cy", "d2", "mx", "my")])


@F.pandas_udf(_TERMS)
def _edge_terms(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
    """Of each edge: cross product, its moments, squared length, doubled midpoint."""
    out = []
    for a, b, c, d in zip(*([Fraction(v) for v in s] for s in (x1, y1, x2, y2))):
        cross = a * d - c * b
        out.append([format_rational(v) for v in (cross, cross * (a + c), cross * (b + d), (c - a) ** 2 + (d - b) ** 2, a + c, b + d)])
    return pd.DataFrame(out, columns=list(_TERMS.names))


@F.pandas_udf(T.StringType())
def _turned_sum(rows: pd.Series) -> pd.Series:
    out = []
    for some in rows:
        total = Fraction(0)
        for r in some:
            s = Fraction(r["c"])
            total += Fraction(r["v"]) * (1 if s > 0 else -1 if s < 0 else 0) * (1 if r["ring"] == 0 else -1)
        out.append(format_rational(total))
    return pd.Series(out, dtype=object)


def _polygonal_total(value: str, cross: str, ring: str) -> Column:
    """Aggregate: the sum of rings' values turned so that shells count positive and holes negative."""
    return _turned_sum(F.collect_list(F.struct(F.col(value).alias("v"), F.col(cross).alias("c"), F.col(ring).alias("ring"))))


@F.pandas_udf(T.StringType())
def _over(n: pd.Series, d: pd.Series, k: pd.Series) -> pd.Series:
    """n / (k d), null where d is zero."""
    return pd.Series([None if a is None or b is None or Fraction(b) == 0 else format_rational(Fraction(a) / (Fraction(b) * int(f))) for a, b, f in zip(n, d, k)], dtype=object)


def ring_sums(geoms: DataFrame) -> DataFrame:
    """id, elem, ring, c, cx, cy of polygon rings: twice the signed area and the moments."""
    steps = _steps(coordinates(geoms).where(F.col("kind") == POLYGON)).withColumn("t", _edge_terms("x", "y", "x2", "y2"))
    return steps.groupBy("id", "elem", "ring").agg(*(rational_sum(F.col(f"t.{k}")).alias(k) for k in ("c", "cx", "cy")))


def area(geoms: DataFrame) -> DataFrame:
    """(id, area): shells less holes over all polygon elements, as exact text."""
    sums = ring_sums(geoms).groupBy("id").agg(_polygonal_total("c", "c", "ring").alias("s"))
    two = F.lit("2")
    return _beside(geoms.select("id"), sums).select("id", F.coalesce(_over(F.col("s"), two, F.lit(1)), F.lit("0")).alias("area"))


def area_native(coords: DataFrame) -> DataFrame:
    """(id, area2) of integer coordinates (id, elem, kind, ring, i, x, y as BIGINT): twice the area, all in the JVM."""
    steps = _steps(coords.where(F.col("kind") == POLYGON))
    rings = steps.groupBy("id", "elem", "ring").agg(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))).alias("a"))
    return rings.groupBy("id").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area2"))


def length(geoms: DataFrame) -> DataFrame:
    """(id, length): certified enclosure (lo, hi, rounded) of the lengths of lines."""
    steps = _steps(coordinates(geoms).where(F.col("kind") == LINE)).withColumn("t", _edge_terms("x", "y", "x2", "y2"))
    terms = steps.groupBy("id").agg(F.collect_list("t.d2").alias("d2"))  # the segments of one geometry
    return _beside(geoms.select("id"), terms).select("id", sqrt_sum("d2").alias("length"))


def centroid(geoms: DataFrame) -> DataFrame:
    """(id, x, y): exact centroid of areas, else of points; null for lines and empties."""
    sums = ring_sums(geoms).groupBy("id").agg(*(_polygonal_total(k, "c", "ring").alias(k) for k in ("c", "cx", "cy")))
    three = F.lit(3)
    areal = sums.select("id", _over(F.col("cx"), F.col("c"), three).alias("x"), _over(F.col("cy"), F.col("c"), three).alias("y"))
    points = coordinates(geoms).where(F.col("kind") == POINT).withColumn("t", _edge_terms("x", "y", "x", "y"))
    points = points.groupBy("id").agg(rational_sum(F.col("t.mx")).alias("mx"), rational_sum(F.col("t.my")).alias("my"), rational_sum(F.lit("1")).alias("n"))
    puntal = points.select("id", _over(F.col("mx"), F.col("n"), F.lit(2)).alias("px"), _over(F.col("my"), F.col("n"), F.lit(2)).alias("py"))
    lines = coordinates(geoms).where(F.col("kind") == LINE).select("id").distinct().withColumn("_line", F.lit(True))
    rows = _beside(_beside(_beside(geoms.select("id"), areal), puntal), lines)
    return rows.select("id", F.coalesce("x", F.when(F.col("_line").isNull(), F.col("px"))).alias("x"), F.coalesce("y", F.when(F.col("_line").isNull(), F.col("py"))).alias("y"))


def line_centroid(geoms: DataFrame) -> DataFrame:
    """(id, x, y): certified enclosures (lo, hi, rounded) of the centroid of lines by length; null without length.

    Segments of one length are added up first, so that a geometry has one term for each of its lengths.
    """
    steps = _steps(coordinates(geoms).where(F.col("kind") == LINE)).withColumn("t", _edge_terms("x", "y", "x2", "y2"))
    terms = steps.groupBy("id", F.col("t.d2").alias("q")).agg(*(rational_sum(F.col(f"t.m{c}")).alias(f"m{c}") for c in "xy"), F.count(F.lit(1)).alias("n"))
    halves = terms.select("id", "q", "n", *(_over(F.col(f"m{c}"), F.lit("1"), F.lit(2)).alias(f"m{c}") for c in "xy"))
    return _beside(geoms.select("id"), weighted_means(halves))


def weighted_means(terms: DataFrame) -> DataFrame:
    """(id, x, y): enclosures (lo, hi, rounded) of sum(sqrt(q) m) / sum(sqrt(q) n) over the terms (id, q, mx, my, n) of each id.

    Terms arrive sorted by id: a task holds a batch of them and one geometry's, however many geometries it has.
    """

    def run(batches):
        now, held, out = None, [], []

        def close():
            if held:
                out.append((now, *(root_weighted_mean((q, m[k], n) for q, m, n in held) for k in (0, 1))))

        for batch in batches:
            for i, q, mx, my, n in zip(*(batch.column(c).to_pylist() for c in ("id", "q", "mx", "my", "n"))):
                if held and i != now:
                    close()
                    held = []
                now = i
                held.append((q, (mx, my), n))
            yield _mean_rows(out, batch.schema.field("id").type)
            out = []
        if held:
            close()
            yield _mean_rows(out, batch.schema.field("id").type)

    kind, mean = terms.schema["id"].dataType.simpleString(), ENCLOSURE.simpleString()
    rows = terms.select("id", "q", "mx", "my", "n").repartition("id").sortWithinPartitions("id")
    return rows.mapInArrow(run, f"id {kind}, x {mean}, y {mean}")


def _mean_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    mean = pa.struct([("lo", pa.string()), ("hi", pa.string()), ("rounded", pa.float64())])
    of = lambda k: pa.array([dict(zip(("lo", "hi", "rounded"), r[k] or (None,) * 3)) for r in rows], mean)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), of(1), of(2)], ["id", "x", "y"])


def case_measures(geoms: DataFrame) -> DataFrame:
    """(id, area, length, centroid, line_centroid, hull): all measures of geometries (id, geom), one row each.

    ``centroid`` (x, y) is exact, of areas or else of points; ``line_centroid`` encloses that of lines, and is null beside areas.
    """
    middle = centroid(geoms).select("id", F.when(F.col("x").isNotNull(), F.struct("x", "y")).alias("centroid"))
    lines = line_centroid(geoms).select("id", F.when(F.col("x.rounded").isNotNull(), F.struct("x", "y")).alias("_line"))
    rows = _beside(area(geoms), length(geoms), middle, lines, how="inner")
    rows = _beside(rows, convex_hull(geoms))
    return rows.select("id", "area", "length", "centroid", F.when(F.col("area") == "0", F.col("_line")).alias("line_centroid"), "hull")


def even_odd_area(edges: DataFrame) -> DataFrame:
    """(id, area2): twice the area that rings enclose by the even-odd rule, from their edges (id, x1, y1, x2, y2 as BIGINT below 2 ** 20).

    Edges meet in their ends only, or coincide: two that coincide cancel; edges that meet elsewhere raise an error
    (``slabs.even_odd_area`` takes them). Distinct abscissas cut the plane into slabs; an edge is ranked
    from below in the first slab that it crosses, and the parity of its rank says on which side of it the area lies.
    """
    _refuse_crossings(edges)
    flat = edges.where("x1 <> x2").select("id", *(F.when(F.col("x1") < F.col("x2"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))))
    flat = flat.groupBy("id", "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")
    starts = flat.select("id", F.explode(F.array("x1", "x2")).alias("left")).distinct()
    slabs = starts.withColumn("right", F.lead("left").over(Window.partitionBy("id").orderBy("left"))).where("right IS NOT NULL")
    rows = flat.join(slabs, "id").where((F.col("x1") <= F.col("left")) & (F.col("right") <= F.col("x2")))
    # the height in the middle of a slab; heights of edges that do not meet there differ by more than 10 ** -18
    whole = lambda c: c.cast("decimal(20,0)")
    rise = (F.col("left") + F.col("right") - 2 * F.col("x1")) * (F.col("y2") - F.col("y1")) + 2 * F.col("y1") * (F.col("x2") - F.col("x1"))
    rows = rows.withColumn("_at", whole(rise) / whole(2 * (F.col("x2") - F.col("x1"))))
    rank = F.row_number().over(Window.partitionBy("id", "left").orderBy("_at"))
    first = rows.withColumn("_rank", rank).where(F.col("left") == F.col("x1"))
    turn = F.when(F.col("_rank") % 2 == 1, -1).otherwise(1)  # odd from below: the area begins here
    return first.groupBy("id").agg(F.sum(turn * (F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2"))).alias("area2"))


def _refuse_crossings(edges: DataFrame) -> None:
    ident = F.monotonically_increasing_id()
    segs = edges.where("NOT (x1 = x2 AND y1 = y2)").select(F.col("id").alias("pair"), F.lit(0).alias("g"), F.lit(0).alias("elem"), F.lit(0).alias("ring"), ident.alias("i"), "x1", "y1", "x2", "y2")
    lane = LANES["narrow"]
    met = candidate_pairs(materialize(segs, "ring-edges"), lane)
    met = met.select("pair", F.explode(lane.crossings(*(F.col(f"{p}{c}") for p in "st" for c in ("x1", "y1", "x2", "y2")))).alias("p"), "*")
    is_end = lambda s: (F.col("p") == lane.point(F.col(f"{s}x1"), F.col(f"{s}y1"))) | (F.col("p") == lane.point(F.col(f"{s}x2"), F.col(f"{s}y2")))
    bad = met.where(~(is_end("s") & is_end("t"))).select("p").first()
    if bad is not None:
        raise ValueError(f"edges meet at ({bad.p.X}/{bad.p.W}, {bad.p.Y}/{bad.p.W}), which is no end of both")


def overlap_area2(area_a: Column, area_b: Column, area_symmetric: Column) -> Column:
    """Twice the common area, from both areas and that of the symmetric difference."""
    return area_a + area_b - area_symmetric


#: Geometries whose points are Python objects at once.
HULL_ROWS = 64


def _hull(points: list[dict]) -> list[dict]:
    """Corners of the hull of points, by the two chains of the points in order."""

    def half(pts, exact):
        out: list = []
        for p in pts:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = exact[out[-2]], exact[out[-1]], exact[p]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(p)
        return out

    pts = sorted({(p["x"], p["y"]) for p in points})
    exact = {p: (Fraction(p[0]), Fraction(p[1])) for p in pts}
    hull = pts if len(pts) < 3 else half(pts, exact)[:-1] + half(pts[::-1], exact)[:-1]
    return [{"x": x, "y": y} for x, y in hull]


def _hulls(batches):
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, HULL_ROWS):
            some = batch.slice(at, HULL_ROWS)
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([_hull(p) for p in some.column("p").to_pylist()], kind)], ["id", "hull"])


def convex_hull(geoms: DataFrame) -> DataFrame:
    """(id, hull): convex hull as an array of (x, y) from its least point counter-clockwise, not closed, collinear points left out."""
    outer = coordinates(geoms).where((F.col("kind") != POLYGON) | (F.col("ring") == 0))
    points = outer.groupBy("id").agg(F.collect_set(F.struct("x", "y")).alias("p"))  # the points of one geometry
    return points.mapInArrow(_hulls, f"id {geoms.schema['id'].dataType.simpleString()}, hull array<struct<x:double,y:double>>")


_NEAREST = T.StructType([T.StructField(k, T.StringType()) for k in ("d2", "ax", "ay", "bx", "by")])


@F.pandas_udf(_NEAREST)
def _segment_distance(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, x3: pd.Series, y3: pd.Series, x4: pd.Series, y4: pd.Series) -> pd.DataFrame:
    """Exact squared distance of two segments (points where both ends agree) and where it is taken."""

    def to_segment(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        t = min(max(((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n, Fraction(0)), Fraction(1)) if n else Fraction(0)
        q = (a[0] + t * d[0], a[1] + t * d[1])
        return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, q

    out = []
    for v in zip(*([Fraction(v) for v in s] for s in (x1, y1, x2, y2, x3, y3, x4, y4))):
        a, b, c, d = v[0:2], v[2:4], v[4:6], v[6:8]
        u, w = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
        den = u[0] * w[1] - u[1] * w[0]
        best = None
        if den:
            t = ((c[0] - a[0]) * w[1] - (c[1] - a[1]) * w[0]) / den
            s = ((c[0] - a[0]) * u[1] - (c[1] - a[1]) * u[0]) / den
            if 0 <= t <= 1 and 0 <= s <= 1:
                p = (a[0] + t * u[0], a[1] + t * u[1])
                best = (Fraction(0), p, p)
        if best is None:
            options = []
            for p in (a, b):
                dist, q = to_segment(p, c, d)
                options.append((dist, p, q))
            for p in (c, d):
                dist, q = to_segment(p, a, b)
                options.append((dist, q, p))
            best = min(options)
        out.append([format_rational(x) for x in (best[0], *best[1], *best[2])])
    return pd.DataFrame(out, columns=list(_NEAREST.names))


def _parts(coords: DataFrame, g: int) -> DataFrame:
    """Segments, and points as segments without length, of one side of the pairs."""
    rows = coords.where((F.col("g") == g) & (F.col("x2").isNotNull() | (F.col("i") == 0)))
    return rows.select("pair", F.col("x").alias(f"x1_{g}"), F.col("y").alias(f"y1_{g}"), F.coalesce("x2", "x").alias(f"x2_{g}"), F.coalesce("y2", "y").alias(f"y2_{g}"))


def _inside(pairs: DataFrame) -> DataFrame:
    """(pair, g, elem) of elements whose first vertex lies in (or on) a polygon of the pair's other geometry."""

    def job(some: DataFrame, lane: str) -> DataFrame:
        k = LANES[lane]
        coords = materialize(model.on_grid(model.coordinates(some), k), "coordinates")
        at = k.point(F.col("x"), F.col("y"))
        probes = coords.where("ring = 0 AND i = 0").select("pair", F.struct("g", "elem").alias("id"), at.alias("u"), at.alias("v"), F.lit(False).alias("level"))
        at = covers(probes, model.segments(coords), k)
        return at.where(F.when(F.col("id.g") == 0, F.col("b_plus") | F.col("b_on")).otherwise(F.col("a_plus") | F.col("a_on"))).select("pair", "id.g", "id.elem")

    return on_either_lane(pairs, job)


def distance2(pairs: DataFrame) -> DataFrame:
    """(pair, distance2, ax, ay, bx, by): exact squared distance and points where it is taken; null for empties.

    Where an element lies inside a polygon of the other geometry the distance is 0, taken at its first vertex.
    """
    coords = model.coordinates(pairs)
    rows = _parts(coords, 0).join(_parts(coords, 1), "pair")
    # doubles first: only parts whose boxes can hold the least distance are measured exactly
    gap = lambda k: F.greatest(F.lit(0.0), F.greatest(F.least(f"{k}1_0", f"{k}2_0") - F.greatest(f"{k}1_1", f"{k}2_1"), F.least(f"{k}1_1", f"{k}2_1") - F.greatest(f"{k}1_0", f"{k}2_0")))
    reach = F.pow(F.col("x1_0") - F.col("x1_1"), 2) + F.pow(F.col("y1_0") - F.col("y1_1"), 2)
    rows = rows.withColumn("_low", F.pow(gap("x"), 2) + F.pow(gap("y"), 2)).withColumn("_high", F.min(reach).over(Window.partitionBy("pair")))
    rows = rows.where(F.col("_low") <= F.col("_high") * (1 + 1e-9) + 1e-300)
    rows = rows.withColumn("n", _segment_distance(*(f"{k}{e}_{g}" for g in (0, 1) for e in (1, 2) for k in "xy")))
    least = rows.groupBy("pair").agg(rational_min(F.col("n.d2")).alias("distance2"))
    at = rows.join(least, "pair").where(F.col("n.d2") == F.col("distance2")).groupBy("pair").agg(F.min("n").alias("n"))
    out = pairs.select("pair").join(at, "pair", "left").select("pair", F.col("n.d2").alias("distance2"), "n.ax", "n.ay", "n.bx", "n.by")
    first = _inside(pairs).groupBy("pair").agg(F.min(F.struct("g", "elem")).alias("s")).select("pair", "s.g", "s.elem")
    met = first.join(coords.where("ring = 0 AND i = 0"), ["pair", "g", "elem"]).select("pair", to_rational("x").alias("_x"), to_rational("y").alias("_y"))
    apart = F.col("_x").isNull() | (F.col("distance2") == "0")
    values = {"distance2": F.lit("0"), "ax": F.col("_x"), "ay": F.col("_y"), "bx": F.col("_x"), "by": F.col("_y")}
    return out.join(met, "pair", "left").select("pair", *(F.when(apart, F.col(c)).otherwise(v).alias(c) for c, v in values.items()))


def nearest(left: DataFrame, right: DataFrame, cell: float, k: int = 1) -> DataFrame:
    """The ``k`` nearest points of ``right`` (id, x, y) within ``cell`` of each of ``left``, on a grid of such cells."""
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.select(F.col("id").alias("left_id"), F.col("x").alias("x_l"), F.col("y").alias("y_l"), at("x").alias("cx"), at("y").alias("cy"))
    b = right.select(F.col("id").alias("right_id"), "x", "y", F.explode(around).alias("d"), at("x").alias("cx"), at("y").alias("cy"))
    b = b.select("right_id", "x", "y", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    d2 = (F.col("x_l") - F.col("x")) * (F.col("x_l") - F.col("x")) + (F.col("y_l") - F.col("y")) * (F.col("y_l") - F.col("y"))
    rows = a.join(b, ["cx", "cy"]).withColumn("distance2", d2).where(F.col("distance2") <= cell * cell)
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy("distance2", "right_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("left_id", "right_id", "distance2", "rank")


def _two_least(points: DataFrame) -> DataFrame:
    """(id, x, y): of each place the two least ids. Whatever a point's own id is, one of them is the least other id there."""
    least = points.groupBy("x", "y").agg(F.min("id").alias("one"))
    rest = points.join(least, ["x", "y"]).where("id > one").groupBy("x", "y").agg(F.min("id").alias("id"))
    return least.withColumnRenamed("one", "id").unionByName(rest)


def nearest_other(points: DataFrame, cell: float) -> DataFrame:
    """(left_id, right_id, distance2): the nearest other point of each point (id, x, y), the least id of equals; none where there is no other.

    Places that several ids share are settled first, by an equi-join; a place stands in the grid with its two least ids, however many it
    has. The grid starts with cells of ``cell`` and doubles them for the points that have no neighbour within a cell's size.
    """
    points = materialize(points.select("id", "x", "y").where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), "points")
    wide, high = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if wide is None:
        return points.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.col("x").alias("distance2"))
    places = materialize(_two_least(points), "places")
    here = points.join(places.select("x", "y", F.col("id").alias("right_id")), ["x", "y"]).where("id <> right_id")
    here = here.groupBy(F.col("id").alias("left_id")).agg(F.min("right_id").alias("right_id"))
    zero = F.col("x") - F.col("x")
    kind = points.select((zero * zero + zero * zero).alias("distance2")).schema["distance2"].dataType
    out = materialize(here.withColumn("distance2", F.lit(0).cast(kind)), "nearest")
    left = materialize(points.join(out, F.col("id") == F.col("left_id"), "left_anti"), "left")
    while not left.isEmpty():
        found = materialize(nearest_within(left, places, cell), "nearest")
        out = out.unionByName(found)
        if cell * cell >= float(wide) ** 2 + float(high) ** 2:
            break
        left = materialize(left.join(found, F.col("id") == F.col("left_id"), "left_anti"), "left")
        cell *= 2
    return out


def nearest_within(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(left_id, right_id, distance2): the nearest point of ``right`` with another id within ``cell`` of each of ``left``."""
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.select(F.col("id").alias("left_id"), F.col("x").alias("x_l"), F.col("y").alias("y_l"), at("x").alias("cx"), at("y").alias("cy"))
    b = right.select(F.col("id").alias("right_id"), "x", "y", F.explode(around).alias("d"), at("x").alias("cx"), at("y").alias("cy"))
    b = b.select("right_id", "x", "y", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    d2 = (F.col("x_l") - F.col("x")) * (F.col("x_l") - F.col("x")) + (F.col("y_l") - F.col("y")) * (F.col("y_l") - F.col("y"))
    rows = a.join(b, ["cx", "cy"]).where("left_id <> right_id").withColumn("distance2", d2).where(F.col("distance2") <= cell * cell)
    best = rows.groupBy("left_id").agg(F.min(F.struct("distance2", "right_id")).alias("m"))
    return best.select("left_id", "m.right_id", "m.distance2")


def ring_is_ccw(area2: Column) -> Column:
    return area2 > 0
