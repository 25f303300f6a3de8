"""Areas by vertical slabs: the reference route of overlay areas, without noding labels.

The abscissas of all edge ends and of all points where edges meet cut a pair's plane into slabs. Inside a slab no two edges
meet, so the edges that cross it have an order from below; the parity of each side's edges so far says which
strips between neighbours it holds (even-odd rule), and an operation's area is the sum of its strips. An edge is joined to the slabs that
it crosses; only the few edges of one slab meet in the helper that orders them exactly.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from terrazzo.functions.exact import format_rational, rational_sum
from terrazzo.functions.kernels import LANES
from terrazzo.operators import model, noding
from terrazzo.operators.overlay import OPERATIONS, unscaled
from terrazzo.session import materialize

_AREAS = T.StructType([T.StructField(n, T.StringType()) for n in OPERATIONS])


def strips(edges: list[tuple], left: Fraction, right: Fraction) -> dict[str, Fraction]:
    """Area of each operation in one slab, from the edges (side, x1, y1, x2, y2; x1 < x2) that cross it."""
    middle = (left + right) / 2
    at = sorted((y1 + (y2 - y1) * (middle - x1) / (x2 - x1), g) for g, x1, y1, x2, y2 in edges)
    areas = dict.fromkeys(OPERATIONS, Fraction(0))
    inside = [False, False]
    for (y, g), (above, _) in zip(at, at[1:]):
        inside[g] = not inside[g]
        for name, holds in OPERATIONS.items():
            if above > y and _holds(holds, *inside):
                areas[name] += (above - y) * (right - left)
    return areas


def _holds(holds, a: bool, b: bool) -> bool:
    return bool(holds(int(a), int(b)) & 1)


@F.pandas_udf(_AREAS)
def _strips(edges: pd.Series, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    at = lambda d: [Fraction(int(x), int(w)) for x, w in zip(d["X"], d["W"])]
    out = []
    for some, a, b in zip(edges, at(left), at(right)):
        found = strips([(r["g"], *(Fraction(int(r[c])) for c in ("x1", "y1", "x2", "y2"))) for r in some], a, b)
        out.append([format_rational(v) for v in found.values()])
    return pd.DataFrame(out, columns=list(OPERATIONS))


def _sorted(points: Column, lane: str) -> Column:
    """Distinct abscissas (X, W) in order."""
    if lane == "wide":
        return _wide_order(points)
    big = lambda c: c.cast("decimal(38,0)")
    less = lambda p, q: big(p["X"]) * big(q["W"]) - big(q["X"]) * big(p["W"])
    return F.array_sort(points, lambda p, q: F.when(less(p, q) < 0, -1).when(less(p, q) > 0, 1).otherwise(0))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in "XW"])))
def _wide_order(points: pd.Series) -> pd.Series:
    return pd.Series([sorted(({"X": p["X"], "W": p["W"]} for p in some), key=lambda p: Fraction(int(p["X"]), int(p["W"]))) for some in points], dtype=object)


@F.pandas_udf(T.BooleanType())
def _wide_crosses(x1: pd.Series, x2: pd.Series, left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
    rows = zip(map(int, x1), map(int, x2), *(map(int, d[k]) for d in (left, right) for k in "XW"))
    return pd.Series([a * lw <= lx and rx <= b * rw for a, b, lx, lw, rx, rw in rows], dtype=bool)


def slab_areas(segs: DataFrame, lane: str = "narrow") -> DataFrame:
    """(pair, intersection, union, difference, symdifference): exact areas, as text, of two sides whose edges (pair, g, elem, ring, i, x1, y1, x2, y2) follow the even-odd rule."""
    k = LANES[lane]
    segs = materialize(model.with_slabs(segs, ("x1", "y1"), ("x2", "y2")), "slab-edges")
    ordinates = [F.col(f"{p}{c}") for p in "st" for c in ("x1", "y1", "x2", "y2")]
    met = noding.candidate_pairs(segs, k).select("pair", F.explode(k.crossings(*ordinates)).alias("p"))
    ends = segs.select("pair", F.explode(F.array(*(k.point(F.col(f"x{n}"), F.col(f"y{n}")) for n in (1, 2)))).alias("p"))
    cuts = met.unionByName(ends).select("pair", _abscissa(F.col("p"), lane).alias("x")).distinct()
    cuts = cuts.groupBy("pair").agg(F.collect_list("x").alias("x")).select("pair", _sorted(F.col("x"), lane).alias("x"))  # of one pair
    between = F.zip_with(F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    slabs = cuts.select("pair", F.posexplode(between).alias("k", "s")).select("pair", "k", "s.left", "s.right")
    swap = F.col("x1").cast("double") > F.col("x2").cast("double") if lane == "narrow" else _greater("x1", "x2")
    flat = segs.where("x1 <> x2").withColumn("_swap", swap)
    flat = flat.select("pair", "g", *(F.when(F.col("_swap"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))))
    if lane == "narrow":  # an ordinate is below 2 ** 20 and W below 2 ** 42
        crosses = (F.col("x1") * F.col("left.W") <= F.col("left.X")) & (F.col("right.X") <= F.col("x2") * F.col("right.W"))
    else:
        crosses = _wide_crosses("x1", "x2", "left", "right")
    rows = flat.join(slabs, "pair").where(crosses)
    held = rows.groupBy("pair", "k").agg(F.collect_list(F.struct("g", "x1", "y1", "x2", "y2")).alias("edges"), F.first("left").alias("left"), F.first("right").alias("right"))
    areas = held.select("pair", _strips("edges", "left", "right").alias("a"))
    return areas.groupBy("pair").agg(*(rational_sum(F.col(f"a.{n}")).alias(n) for n in OPERATIONS))


def _abscissa(p: Column, lane: str) -> Column:
    """X / W of a point in lowest terms."""
    if lane == "wide":
        return _wide_abscissa(p)
    return _narrow_abscissa(p["X"], p["W"])


_RATIO = T.StructType([T.StructField("X", T.LongType()), T.StructField("W", T.LongType())])


@F.pandas_udf(_RATIO)
def _narrow_abscissa(x: pd.Series, w: pd.Series) -> pd.DataFrame:
    g = np.gcd(np.abs(x.to_numpy()), w.to_numpy())
    return pd.DataFrame({"X": x // g, "W": w // g})


@F.pandas_udf(T.StructType([T.StructField("X", T.StringType()), T.StructField("W", T.StringType())]))
def _wide_abscissa(p: pd.DataFrame) -> pd.DataFrame:
    q = [Fraction(int(x), int(w)) for x, w in zip(p["X"], p["W"])]
    return pd.DataFrame({"X": [str(v.numerator) for v in q], "W": [str(v.denominator) for v in q]})


@F.pandas_udf(T.BooleanType())
def _greater(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([int(x) > int(y) for x, y in zip(a, b)], dtype=bool)


def overlay_areas(pairs: DataFrame, lane: str | None = None) -> DataFrame:
    """(pair, op, area): the areas of all operations over the polygons of pairs (pair, a, b), each geometry by the even-odd rule; "0" without edges."""
    if lane is None:
        return noding.on_either_lane(pairs, overlay_areas)
    coords = model.coordinates(pairs).where(F.col("kind") == model.POLYGON)
    areas = slab_areas(model.segments(model.on_grid(coords, LANES[lane])), lane)
    rows = pairs.select("pair").join(areas, "pair", "left")
    every = F.array(*(F.struct(F.lit(n).alias("op"), F.coalesce(n, F.lit("0")).alias("area")) for n in OPERATIONS))
    out = rows.select("pair", F.explode(every).alias("r")).select("pair", "r.op", "r.area")
    return unscaled(out, pairs, "area", 2, lane)


def even_odd_area(edges: DataFrame) -> DataFrame:
    """(id, area): the exact area, as text, that closed rings enclose by the even-odd rule, from their edges (id, x1, y1, x2, y2 as BIGINT below 2 ** 20), which may cross, touch and coincide."""
    rows = edges.withColumn("i", F.monotonically_increasing_id()).select(F.col("id").alias("pair"), F.lit(0).alias("g"), F.lit(0).alias("elem"), F.lit(0).alias("ring"), "i", "x1", "y1", "x2", "y2")
    rows = rows.where("NOT (x1 = x2 AND y1 = y2)")
    areas = slab_areas(rows).select(F.col("pair").alias("id"), F.col("union").alias("area"))
    return edges.select("id").distinct().join(areas, "id", "left").select("id", F.coalesce("area", F.lit("0")).alias("area"))
