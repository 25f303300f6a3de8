"""Hausdorff distance between points, lines and the rims of polygons, squared: exact where it is rational, enclosed elsewhere.

From one side to the other, the distance is largest at a vertex or where two features of the other side are equally near
to an edge. Vertices come first: each meets the features of the other side, doubles choose the few that can be nearest, and
the exact distance is theirs. Along an edge, the distance to one feature is convex, so the least over
features of the larger of both ends bounds it. Only edges whose bound exceeds what the vertices reach go on, with the features
that can be nearest somewhere on them, to a helper that solves for the places where two of these are equally near.

Defined results: null where either side is empty; repeated vertices and segments without length count once.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrazzo.functions.exact import ENCLOSURE, format_rational, nearest_double, sqrt_bounds
from terrazzo.functions.geometry import POINT
from terrazzo.operators import model
from terrazzo.session import materialize

_SLACK = 1 + 1e-9


def point_distance2(p, f) -> Fraction:
    """Squared distance of a point to a segment (x1, y1, x2, y2), which may be a point."""
    dx, dy = f[2] - f[0], f[3] - f[1]
    n = dx * dx + dy * dy
    t = min(max(((p[0] - f[0]) * dx + (p[1] - f[1]) * dy) / n, 0), 1) if n else 0
    return (p[0] - f[0] - t * dx) ** 2 + (p[1] - f[1] - t * dy) ** 2


def _quadratics(e, f) -> list[tuple]:
    """Squared distances of e(t) = (x1, y1) + t (dx, dy) to the ends of f and to its line, as coefficients of t**2, t and 1."""
    px, py, ux, uy = e[0], e[1], e[2] - e[0], e[3] - e[1]
    out = []
    for x, y in {(f[0], f[1]), (f[2], f[3])}:
        out.append((ux * ux + uy * uy, 2 * (ux * (px - x) + uy * (py - y)), (px - x) ** 2 + (py - y) ** 2))
    vx, vy = f[2] - f[0], f[3] - f[1]
    n = vx * vx + vy * vy
    if n:
        a, b = ux * vy - uy * vx, (px - f[0]) * vy - (py - f[1]) * vx
        out.append((a * a / n, 2 * a * b / n, b * b / n))
    return out


def _roots(a, b, c) -> list[tuple[Fraction, Fraction]]:
    """Enclosures of the roots of a t**2 + b t + c that can lie between 0 and 1."""
    if a == 0:
        found = [(-c / b, -c / b)] if b else []
    else:
        d = b * b - 4 * a * c
        if d < 0:
            return []
        low, high = sqrt_bounds(d)
        found = [tuple(sorted((((-b + s * low) / (2 * a)), ((-b + s * high) / (2 * a))))) for s in (1, -1)]
    return [(lo, hi) for lo, hi in found if hi >= 0 and lo <= 1]


def edge_maximum(e, features: list[tuple], low: Fraction) -> tuple[Fraction, Fraction]:
    """Enclosure of the largest squared distance from the edge e to the nearest of the features, not below ``low``."""
    quads = [_quadratics(e, f) for f in features]
    best_lo = best_hi = low
    at = lambda t: (e[0] + t * (e[2] - e[0]), e[1] + t * (e[3] - e[1]))
    floats = [tuple(map(float, f)) for f in features]
    places = {(Fraction(0), Fraction(0)), (Fraction(1), Fraction(1))}
    for i in range(len(quads)):
        for j in range(i):
            for q in quads[i]:
                for r in quads[j]:
                    places.update(_roots(*(x - y for x, y in zip(q, r))))
    speed = sqrt_bounds((e[2] - e[0]) ** 2 + (e[3] - e[1]) ** 2)[1]
    for lo, hi in places:
        t = min(max(lo, Fraction(0)), Fraction(1))
        p = at(t)
        rough = tuple(map(float, p))
        if min(point_distance2(rough, f) for f in floats) * _SLACK < float(best_lo):
            continue
        value = min(point_distance2(p, f) for f in features)
        move = speed * (hi - lo)  # how far the true place can be
        error = move * (2 * sqrt_bounds(value)[1] + move)
        best_lo, best_hi = max(best_lo, value - error), max(best_hi, value + error)
    return best_lo, best_hi


_FEATURE = ("x1", "y1", "x2", "y2")


@F.pandas_udf(ENCLOSURE)
def _vertex_distance(x: pd.Series, y: pd.Series, near: pd.Series) -> pd.DataFrame:
    out = []
    for a, b, some in zip(x, y, near):
        v = min(point_distance2((Fraction(a), Fraction(b)), [Fraction(f[c]) for c in _FEATURE]) for f in some)
        out.append((format_rational(v), format_rational(v), nearest_double(v)))
    return pd.DataFrame(out, columns=["lo", "hi", "rounded"])


@F.pandas_udf(ENCLOSURE)
def _edge_distance(e: pd.DataFrame, near: pd.Series, low: pd.Series) -> pd.DataFrame:
    out = []
    for own, some, v in zip(zip(*(e[c] for c in _FEATURE)), near, low):
        lo, hi = edge_maximum([Fraction(c) for c in own], [[Fraction(f[c]) for c in _FEATURE] for f in some], Fraction(v))
        out.append((format_rational(lo), format_rational(hi), nearest_double((lo + hi) / 2)))
    return pd.DataFrame(out, columns=["lo", "hi", "rounded"])


@F.pandas_udf(ENCLOSURE)
def _largest(some: pd.Series) -> pd.DataFrame:
    out = []
    for rows in some:
        lo, hi = max(Fraction(r["lo"]) for r in rows), max(Fraction(r["hi"]) for r in rows)
        out.append((format_rational(lo), format_rational(hi), nearest_double((lo + hi) / 2)))
    return pd.DataFrame(out, columns=["lo", "hi", "rounded"])


def _distance2(x: Column, y: Column, c=F.col) -> Column:
    """Squared distance of (x, y) to the feature with the ordinates ``c``, in doubles; by default that of the row."""
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - c("x1")) * dx + (y - c("y1")) * dy) / n)))
    return F.pow(x - c("x1") - t * dx, 2) + F.pow(y - c("y1") - t * dy, 2)


def directed(pairs: DataFrame) -> DataFrame:
    """(pair, g, d2): of each side g of pairs (pair, a, b), the largest squared distance from its points, lines and rims to those of the other (lo, hi, rounded)."""
    coords = model.coordinates(pairs)
    moves = F.col("x2").isNotNull() & ~((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    single = (F.col("kind") == POINT) | moves
    parts = coords.where(single).select("pair", "g", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce("x2", "x").alias("x2"), F.coalesce("y2", "y").alias("y2"))
    flat = coords.groupBy("pair", "g", "elem", "ring").agg(F.count_distinct("x", "y").alias("n"), F.min("x").alias("x1"), F.min("y").alias("y1")).where("n = 1")
    parts = parts.unionByName(flat.select("pair", "g", "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    parts = materialize(parts.distinct(), "hausdorff-features")
    other = parts.withColumn("g", 1 - F.col("g"))  # features as the other side meets them
    spots = coords.select("pair", "g", F.col("x").alias("vx"), F.col("y").alias("vy")).distinct()

    # a vertex meets the other side's features as one array: no row for each, to be sorted and kept in memory
    side = other.groupBy("pair", "g").agg(F.collect_list(F.struct(*_FEATURE)).alias("_f"))
    near = spots.join(side.hint("merge"), ["pair", "g"]).withColumn("_d", F.transform("_f", lambda f: _distance2(F.col("vx"), F.col("vy"), lambda c: f[c])))
    near = near.withColumn("_least", F.array_min("_d"))
    rough = near.select("pair", "g", "vx", "vy", F.filter("_f", lambda f, i: F.get("_d", i) <= F.col("_least") * _SLACK + 1e-300).alias("near"), "_least")
    # of a side's vertices, only those that can be farthest
    rough = materialize(rough.withColumn("_most", F.max("_least").over(Window.partitionBy("pair", "g"))), "hausdorff-vertices")
    far = rough.where(F.col("_least") * _SLACK + 1e-300 >= F.col("_most")).select("pair", "g", _vertex_distance("vx", "vy", "near").alias("d"))
    reached = materialize(far.groupBy("pair", "g").agg(_largest(F.collect_list("d")).alias("d")), "hausdorff-reached")

    edges = parts.where("x1 <> x2 OR y1 <> y2").select("pair", "g", *(F.col(c).alias(f"e{c}") for c in _FEATURE))
    ends = F.greatest(_distance2(F.col("ex1"), F.col("ey1")), _distance2(F.col("ex2"), F.col("ey2")))
    gap = lambda k: F.greatest(F.lit(0.0), F.least(f"e{k}1", f"e{k}2") - F.greatest(f"{k}1", f"{k}2"), F.least(f"{k}1", f"{k}2") - F.greatest(f"e{k}1", f"e{k}2"))
    own = Window.partitionBy("pair", "g", *(f"e{c}" for c in _FEATURE))
    met = edges.join(other, ["pair", "g"]).withColumn("_bound", F.min(ends).over(own)).join(reached, ["pair", "g"])
    met = met.where((F.col("_bound") * _SLACK > F.col("d.rounded")) & (F.pow(gap("x"), 2) + F.pow(gap("y"), 2) <= F.col("_bound") * _SLACK + 1e-300))
    held = met.groupBy("pair", "g", *(f"e{c}" for c in _FEATURE)).agg(F.collect_list(F.struct(*_FEATURE)).alias("near"), F.first("d.lo").alias("low"))
    along = held.select("pair", "g", _edge_distance(F.struct(*(F.col(f"e{c}").alias(c) for c in _FEATURE)), "near", "low").alias("d"))
    return reached.unionByName(along).groupBy("pair", "g").agg(_largest(F.collect_list("d")).alias("d2"))


def hausdorff2(pairs: DataFrame) -> DataFrame:
    """(pair, lo, hi, rounded): the squared Hausdorff distance of pairs (pair, a, b); lo equals hi where it is rational and exact."""
    most = materialize(directed(pairs), "hausdorff").groupBy("pair").agg(_largest(F.collect_list("d2")).alias("d"))
    return pairs.select("pair").join(most, "pair", "left").select("pair", "d.lo", "d.hi", "d.rounded")
