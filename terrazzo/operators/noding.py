"""Noding: the segments of both geometries of each pair split at all points where they meet, with labels.

One row per distinct sub-segment and one per vertex. A sub-segment knows on which sides the
polygons of either geometry lie: rays from just beside its midpoint are counted against the polygon
edges of its pair (parity per element, any element covers). All of it is joins and aggregates by
pair and slab: a pair's plane is cut by y into as many slabs as its segments call for, so that large pairs are
spread over tasks and their segments meet few others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.functions.kernels import LANES
from terrazzo.operators import model
from terrazzo.operators.model import LINE, POLYGON
from terrazzo.session import materialize

NAMES = "ab"


@dataclass(frozen=True)
class Arrangement:
    """``edges``: pair, u, v, level, {a,b}_{line,poly,plus,minus}; ``vertices``: pair, pt, loc_a, loc_b, degree,
    face_{a,b} (of points off all edges: whether polygons cover them); ``pairs`` without those over budget, which are ``over``."""

    edges: DataFrame
    vertices: DataFrame
    pairs: DataFrame
    lane: type
    over: DataFrame | None = None


_ENDS = ("x1", "y1"), ("x2", "y2")


def _real(c: str) -> Column:
    return F.col(c).cast("double")  # rounded monotonically: what meets still meets


def candidate_pairs(segs: DataFrame, lane, wanted: Column | None = None, *extra: str) -> DataFrame:
    """Pairs of segments of one pair whose boxes meet: a self-join by pair and slab with a residual range condition.

    Two segments meet in the first slab that both touch, so each pair of them comes once. ``wanted`` is a further condition on
    s and t and on ``extra`` columns of both, named with s and t before them.
    """
    segs = segs if "_k" in segs.columns else model.with_slabs(segs, *_ENDS)
    ident = F.struct("g", "elem", "ring", "i")
    rows = segs.withColumns({"_low": model.slab(F.least(_real("y1"), _real("y2"))), "_high": model.slab(F.greatest(_real("y1"), _real("y2")))})
    rows = rows.withColumn("_slab", F.explode(F.sequence("_low", "_high")))
    s, t = (rows.select("pair", "_slab", F.col("_low").alias(f"_low_{p}"), ident.alias(p), *(F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2", *extra))) for p in "st")
    number = F.col if lane.name == "narrow" else _real
    low, high = (lambda p, k: F.least(number(f"{p}{k}1"), number(f"{p}{k}2"))), (lambda p, k: F.greatest(number(f"{p}{k}1"), number(f"{p}{k}2")))
    out = s.join(t, ["pair", "_slab"]).where((F.col("s") < F.col("t")) & (F.col("_slab") == F.greatest("_low_s", "_low_t")))
    for m in [low("s", k) <= high("t", k) for k in "xy"] + [low("t", k) <= high("s", k) for k in "xy"]:
        out = out.where(m)
    out = out if wanted is None else out.where(wanted)
    return out.drop("_slab", "_low_s", "_low_t", *(f"{p}{c}" for p in "st" for c in extra))


def _meetings(segs: DataFrame, lane, own_lines: bool) -> DataFrame:
    """(pair, s, t, p): segments that meet, and where.

    Without ``own_lines``, lines of one side are not cut where they meet each other, but for the segments that run along one of the
    other side's: these must have the cuts that it has. Places next to a cut left out lie alike in the other side.
    """
    ordinates = [F.col(f"{p}{c}") for p in "st" for c in ("x1", "y1", "x2", "y2")]
    of = lambda pairs: pairs.withColumn("p", lane.crossings(*ordinates)).where(F.size("p") > 0).select("pair", "s", "t", "p")
    if own_lines:
        return of(candidate_pairs(segs, lane))
    lines = (F.col("s.g") == F.col("t.g")) & (F.col("skind") == LINE) & (F.col("tkind") == LINE)
    cut = materialize(of(candidate_pairs(segs, lane, ~lines, "kind")), "meetings")
    both = cut.where((F.size("p") > 1) & (F.col("s.g") != F.col("t.g")))
    along = materialize(both.select("pair", "s").unionByName(both.select("pair", F.col("t").alias("s"))).distinct(), "along")
    if along.isEmpty():
        return cut
    ident = F.struct("g", "elem", "ring", "i").alias("s")
    some = segs.join(along.select("pair").distinct(), "pair", "left_semi").where(F.col("kind") == LINE).withColumn("s", ident)
    some = some.join(along.withColumn("_along", F.lit(True)), ["pair", "s"], "left").drop("s")
    more = of(candidate_pairs(some, lane, (F.col("s.g") == F.col("t.g")) & (F.col("s_along").isNotNull() | F.col("t_along").isNotNull()), "_along"))
    return cut.unionByName(more)


def split(segs: DataFrame, points: DataFrame, lane, budget: int | None = None, own_lines: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """One row per sub-segment and source segment: pair, g, elem, kind, ring, i, u, v and slabs; and the pairs left out, whose
    segments and meeting points exceed the budget (None: no limit)."""
    segs = segs if "_k" in segs.columns else model.with_slabs(segs, *_ENDS)
    cut = _meetings(segs, lane, own_lines or budget is not None)
    over = None
    if budget is not None:
        cut = materialize(cut, "meetings")
        size = segs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).unionByName(cut.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
        over = materialize(size.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > budget).select("pair"), "over-budget")
        segs, cut, points = (x.join(over, "pair", "left_anti") for x in (segs, cut, points))
    cuts = cut.select("pair", "s", "p").unionByName(cut.select("pair", F.col("t").alias("s"), "p")).select("pair", "s", F.explode("p").alias("p"))
    # points of either geometry that lie on a segment are nodes too
    pts = points.select("pair", _real("x").alias("_px"), _real("y").alias("_py"), lane.point(F.col("x"), F.col("y")).alias("p")).distinct()
    near = F.col("_px").between(F.least(_real("x1"), _real("x2")), F.greatest(_real("x1"), _real("x2"))) & F.col("_py").between(F.least(_real("y1"), _real("y2")), F.greatest(_real("y1"), _real("y2")))
    on = lane.beside(F.col("p"), F.col("p"), F.lit(False), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))["on"]
    ident = F.struct("g", "elem", "ring", "i")
    cuts = cuts.unionByName(segs.join(pts, "pair").where(near).where(on).select("pair", ident.alias("s"), "p"))
    cuts = cuts.groupBy("pair", "s").agg(F.collect_set("p").alias("more"))
    rows = segs.withColumn("s", ident).join(cuts, ["pair", "s"], "left")
    ends = F.array(lane.point(F.col("x1"), F.col("y1")), lane.point(F.col("x2"), F.col("y2")))
    every = F.concat(ends, F.coalesce("more", F.array().cast(f"array<{lane.point_type}>")))
    pieces = lane.pieces(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), every)
    own = "pair", "g", "elem", "kind", "ring", "i", *model.SLABS
    return rows.select(*own, F.explode(pieces).alias("e")).select(*own, "e.u", "e.v"), over


def ray_hits(probes: DataFrame, segs: DataFrame, lane) -> DataFrame:
    """(pair, id, g, elem, plus, minus, on): the polygon edges that rays from just beside the midpoints of probes (pair, id, u, v, level) meet.

    Probes and edges are joined by pair and slab. Doubles decide, inside the join, wherever an error bound says that
    they decide rightly; only the few edges next to a probe reach the exact kernel.
    """
    segs = segs if "_k" in segs.columns else model.with_slabs(segs, *_ENDS)
    if "_k" not in probes.columns:
        probes = probes.join(segs.select("pair", *model.SLABS).distinct(), "pair")
    ends = ("x1", "y1", "x2", "y2")
    part = lambda p, k: F.col(f"{p}.{k}").cast("double") / F.col(f"{p}.W").cast("double")
    probes = probes.withColumns({"_px": (part("u", "X") + part("v", "X")) / 2, "_py": (part("u", "Y") + part("v", "Y")) / 2})
    probes = probes.withColumn("_slab", model.slab(F.col("_py")))
    slack = F.col("_big") * 2.0**-44
    edges = segs.where(F.col("kind") == POLYGON).withColumns({f"_{c}": _real(c) for c in ends})
    low, high = F.least("_y1", "_y2"), F.greatest("_y1", "_y2")
    edges = edges.withColumn("_slab", F.explode(F.sequence(model.slab(low - slack), model.slab(high + slack))))
    rows = probes.join(edges.select("pair", "_slab", "g", "elem", *ends, *(f"_{c}" for c in ends)), ["pair", "_slab"])

    small = F.col("_big") < model.FILTERED
    beyond = small & ((F.col("_py") < low - slack) | (F.col("_py") > high + slack))
    cross = (F.col("_x2") - F.col("_x1")) * (F.col("_py") - F.col("_y1")) - (F.col("_y2") - F.col("_y1")) * (F.col("_px") - F.col("_x1"))
    apart = (F.abs(F.col("_y1") - F.col("_py")) > slack) & (F.abs(F.col("_y2") - F.col("_py")) > slack)
    sure = small & apart & (F.abs(cross) > F.col("_big") * F.col("_big") * 2.0**-40)
    rows = rows.where(~beyond)
    right = (cross > 0) == (F.col("_y2") > F.col("_y1"))
    known = rows.where(sure).select("pair", "id", "g", "elem", right.alias("plus"), right.alias("minus"), F.lit(False).alias("on")).where("plus")
    h = lane.beside(F.col("u"), F.col("v"), F.col("level"), *(F.col(c) for c in ends))
    exact = rows.where(~sure).withColumn("h", h).select("pair", "id", "g", "elem", "h.plus", "h.minus", "h.on").where("plus OR minus OR on")
    return known.unionByName(exact)


def covers(probes: DataFrame, segs: DataFrame, lane) -> DataFrame:
    """For the midpoints of probes (pair, id, u, v, level): on which sides any polygon element of each geometry lies, and boundary contact."""
    odd = lambda c: F.sum(F.col(c).cast("int")) % 2 == 1
    per = ray_hits(probes, segs, lane).groupBy("pair", "id", "g", "elem").agg(odd("plus").alias("plus"), odd("minus").alias("minus"), F.bool_or("on").alias("on"))
    of = lambda c, k: F.coalesce(F.bool_or(F.col(c) & (F.col("g") == k)), F.lit(False))
    return per.groupBy("pair", "id").agg(*(of(c, k).alias(f"{n}_{c}") for k, n in enumerate(NAMES) for c in ("plus", "minus", "on")))


def edge_location(n: str) -> Column:
    """I, B or E of a sub-segment's interior: polygons decide first, then lines."""
    plus, minus = F.col(f"{n}_plus"), F.col(f"{n}_minus")
    return F.when(plus & minus, "I").when(plus | minus | F.col(f"{n}_poly"), "B").when(F.col(f"{n}_line"), "I").otherwise("E")


def arrange(pairs: DataFrame, lane: str = "narrow", budget: int | None = None, own_lines: bool = True) -> Arrangement:
    """The labelled arrangement of pairs (pair, a, b), without those whose segments and meeting points exceed the budget.

    Without ``own_lines`` it is one for matrices: lines of one side that meet each other need not be cut there.
    """
    k = LANES[lane]
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not for AQE to coalesce
    coords = materialize(model.with_slabs(model.on_grid(model.coordinates(pairs), k).repartition(tasks, "pair")), "coordinates")
    segs, points, ends = model.segments(coords), model.isolated_points(coords), model.line_ends(coords, k)
    pieces, over = split(segs, points, k, budget, own_lines)
    if over is not None and not over.isEmpty():
        segs, points, ends, pairs = (x.join(over, "pair", "left_anti") for x in (segs, points, ends, pairs))
    has = lambda g, kind: F.bool_or((F.col("g") == g) & (F.col("kind") == kind))
    edges = pieces.groupBy("pair", "u", "v", *model.SLABS).agg(*(has(g, kind).alias(f"{n}_{c}") for g, n in enumerate(NAMES) for c, kind in (("line", LINE), ("poly", POLYGON))))
    edges = edges.withColumn("level", k.level(F.col("u"), F.col("v")))
    edges = materialize(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    sides = covers(edges.select("pair", "id", "u", "v", "level", *model.SLABS), segs, k).drop("a_on", "b_on")
    no = [f"{n}_{c}" for n in NAMES for c in ("plus", "minus")]
    edges = materialize(edges.join(sides, ["pair", "id"], "left").na.fill(False, no).drop("id", *model.SLABS), "labelled-edges")

    ends_of = edges.select("pair", F.explode(F.array("u", "v")).alias("pt"), *(f"{n}_{c}" for n in NAMES for c in ("line", "poly", "plus", "minus")))
    known = ends_of.groupBy("pair", "pt").agg(
        F.count(F.lit(1)).alias("degree"),
        *(F.bool_or(f"{n}_{c}").alias(f"{n}_{c}") for n in NAMES for c in ("line", "poly")),
        *(F.bool_or(F.col(f"{n}_plus") | F.col(f"{n}_minus")).alias(f"{n}_some") for n in NAMES),
        *(F.bool_and(F.col(f"{n}_plus") & F.col(f"{n}_minus")).alias(f"{n}_all") for n in NAMES),
    )
    alone = points.select("pair", "g", k.point(F.col("x"), F.col("y")).alias("pt"))
    own = alone.groupBy("pair", "pt").agg(*(F.bool_or(F.col("g") == g).alias(f"{n}_point") for g, n in enumerate(NAMES)))
    inside = covers(own.select("pair", F.col("pt").alias("id"), F.col("pt").alias("u"), F.col("pt").alias("v"), F.lit(False).alias("level")), segs, k).withColumnRenamed("id", "pt")
    odd = ends.groupBy("pair", "pt").agg(*(F.coalesce(F.bool_or(F.col("odd") & (F.col("g") == g)), F.lit(False)).alias(f"{n}_odd") for g, n in enumerate(NAMES)))
    v = known.join(own, ["pair", "pt"], "full").join(inside, ["pair", "pt"], "left").join(odd, ["pair", "pt"], "left")

    def location(n: str) -> Column:
        c = lambda x: F.coalesce(F.col(f"{n}_{x}"), F.lit(False))
        met = F.col("degree").isNotNull()
        area = F.when(met & c("poly"), F.when(c("all"), "I").otherwise("B")).when(met & c("some"), "I").when(~met & c("on"), "B").when(~met & c("plus"), "I")
        return F.coalesce(area, F.when(c("odd"), "B").when(c("line") | c("point"), "I").otherwise("E"))

    vertices = v.select(
        "pair", "pt", *(location(n).alias(f"loc_{n}") for n in NAMES), F.coalesce("degree", F.lit(0)).alias("degree"),
        *(F.coalesce(F.col(f"{n}_plus"), F.lit(False)).alias(f"face_{n}") for n in NAMES),
    )
    edges = edges.select("*", *(edge_location(n).alias(f"loc_{n}") for n in NAMES))
    return Arrangement(edges, materialize(vertices, "vertices"), pairs, k, over)


def on_either_lane(pairs: DataFrame, job, *geoms: str) -> DataFrame:
    """``job(pairs, lane)`` over the pairs that fit the narrow lane and over the others, together; a lane without pairs doesn't run."""
    fits = F.lit(True)
    for c in geoms or NAMES:
        fits = fits & F.coalesce(model.is_grid_integer(F.col(c)), F.lit(True))
    split_ = pairs.withColumn("_narrow", fits)
    lanes = {r["_narrow"] for r in split_.select("_narrow").distinct().collect()}
    if lanes == {False}:
        return job(pairs, "wide")
    if lanes != {True, False}:
        return job(pairs, "narrow")
    return job(split_.where("_narrow").drop("_narrow"), "narrow").unionByName(job(split_.where("NOT _narrow").drop("_narrow"), "wide"))


__all__ = ["Arrangement", "arrange", "candidate_pairs", "covers", "edge_location", "on_either_lane", "ray_hits", "split"]
