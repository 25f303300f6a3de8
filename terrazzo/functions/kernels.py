"""Exact planar arithmetic as column expressions, in two lanes with one interface.

``Narrow`` holds for integer coordinates below 2 ** 20 in size (``integer`` raises beyond): points are
BIGINTs, products that need more are DECIMAL(38, 0) inside the JVM, and where two segments meet is found
by a numpy kernel on whole Arrow batches, whose results fit 63 bits as crossings lie between coordinates.
``Wide`` computes the same quantities on integers of any size, kept as decimal text, in small Arrow
functions. Joins, grouping and windows around them are the same.

Points are homogeneous: (X, Y, W) stands for (X / W, Y / W), W > 0, without common factor, so that
equal points are equal structs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

BITS = 20  # of a coordinate in the narrow lane

NARROW_POINT = "struct<X:bigint,Y:bigint,W:bigint>"
WIDE_POINT = "struct<X:string,Y:string,W:string>"
_POINT = T.StructType([T.StructField(k, T.StringType()) for k in "XYW"])
_PIECE = T.StructType([T.StructField(k, _POINT) for k in "uv"])
_SIDES = T.StructType([T.StructField(k, T.BooleanType()) for k in ("plus", "minus", "on")])


def _dec(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def orient_value(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """(b - a) x (c - a): positive where a, b, c turn left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def sign(value: Column) -> Column:
    """-1, 0 or 1 exactly (signum() goes through DOUBLE)."""
    return F.when(value > 0, 1).when(value < 0, -1).otherwise(0)


def between(v: Column, a: Column, b: Column) -> Column:
    return (v >= F.least(a, b)) & (v <= F.greatest(a, b))


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether p lies on the closed segment a b."""
    return (orient_value(ax, ay, bx, by, px, py) == 0) & between(px, ax, bx) & between(py, ay, by)


def in_segment_interior(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return on_segment(px, py, ax, ay, bx, by) & ~((px == ax) & (py == ay)) & ~((px == bx) & (py == by))


def segments_intersect(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the closed segments a b and c d share a point."""
    o1, o2 = sign(orient_value(ax, ay, bx, by, cx, cy)), sign(orient_value(ax, ay, bx, by, dx, dy))
    o3, o4 = sign(orient_value(cx, cy, dx, dy, ax, ay)), sign(orient_value(cx, cy, dx, dy, bx, by))
    touch = on_segment(cx, cy, ax, ay, bx, by) | on_segment(dx, dy, ax, ay, bx, by) | on_segment(ax, ay, cx, cy, dx, dy) | on_segment(bx, by, cx, cy, dx, dy)
    return ((o1 * o2 < 0) & (o3 * o4 < 0)) | touch


def quadrant(dx: Column, dy: Column) -> Column:
    """0 to 3, counter-clockwise from the positive x axis; each takes its first axis."""
    return F.when((dx > 0) & (dy >= 0), 0).when((dx <= 0) & (dy > 0), 1).when((dx < 0) & (dy <= 0), 2).otherwise(3)


def point_segment_sqdist(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """Squared distance of p to the segment a b as (numerator, denominator)."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = (px - ax) * dx + (py - ay) * dy
    cross = orient_value(ax, ay, bx, by, px, py)
    to_a, to_b = (px - ax) * (px - ax) + (py - ay) * (py - ay), (px - bx) * (px - bx) + (py - by) * (py - by)
    num = F.when((length == 0) | (along <= 0), to_a).when(along >= length, to_b).otherwise(cross * cross)
    den = F.when((length == 0) | (along <= 0) | (along >= length), F.lit(1).cast(T.LongType())).otherwise(length)
    return num, den


def ratio_less(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """n1 / d1 < n2 / d2 for positive denominators."""
    return _dec(n1) * _dec(d2) < _dec(n2) * _dec(d1)


def meetings(*ordinates: pa.Array) -> pa.Array:
    """Where the segments a b and c d of each row meet: no point, one, or the ends of an overlap, as lists of (X, Y, W).

    Ordinates ax, ay, bx, by, cx, cy, dx, dy are below 2 ** BITS; sums may wrap on the way, the crossing itself never does.
    """
    ax, ay, bx, by, cx, cy, dx, dy = (np.asarray(v.to_numpy(zero_copy_only=False), np.int64) for v in ordinates)
    ux, uy, vx, vy, wx, wy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    den, t, u = ux * vy - uy * vx, wx * vy - wy * vx, wx * uy - wy * ux
    points, held = np.ones((len(ax), 4, 3), np.int64), np.zeros((len(ax), 4), bool)
    side, size = np.sign(den), np.abs(den)
    held[:, 0] = (den != 0) & (t * side >= 0) & (t * side <= size) & (u * side >= 0) & (u * side <= size)
    k = np.flatnonzero(held[:, 0])
    x, y, w = (v[k] * side[k] for v in (ax * den + t * ux, ay * den + t * uy, den))
    common = np.gcd(np.gcd(np.abs(x), np.abs(y)), w)
    points[k, 0] = np.stack([x // common, y // common, w // common], axis=1)
    k = np.flatnonzero((den == 0) & (u == 0))
    ends = [(cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by), (ax, ay, cx, cy, dx, dy), (bx, by, cx, cy, dx, dy)]
    for n, end in enumerate(ends):
        p, q, x1, y1, x2, y2 = (v[k] for v in end)
        points[k, n, 0], points[k, n, 1] = p, q
        inside = (p >= np.minimum(x1, x2)) & (p <= np.maximum(x1, x2)) & (q >= np.minimum(y1, y2)) & (q <= np.maximum(y1, y2))
        for m in range(n):
            inside &= ~(held[k, m] & (points[k, m, 0] == p) & (points[k, m, 1] == q))
        held[k, n] = inside
    flat = points[held]
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["X", "Y", "W"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)), fields)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in "XYW"])))
def _narrow_crossings(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array, cx: pa.Array, cy: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
    return meetings(ax, ay, bx, by, cx, cy, dx, dy)


#: Largest W of a midpoint whose orientations fit 63 bits.
_SMALL_W = 1 << 17


def beside(ux, uy, uw, vx, vy, vw, level, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plus, minus, on) of each row: whole columns of 64-bit integers where midpoints are simple, Python's integers elsewhere."""
    simple = (uw <= _SMALL_W) & (vw <= _SMALL_W)
    simple &= np.where(simple, uw, 1) * np.where(simple, vw, 1) <= _SMALL_W // 2
    plus, minus, on = (np.zeros(len(ux), bool) for _ in range(3))

    def settle(k, x, y, w, ax, ay, bx, by, level):
        o = (bx - ax) * (y - ay * w) - (by - ay) * (x - ax * w)
        right = np.where(by > ay, o > 0, o < 0)
        above, reach = (ay * w > y) != (by * w > y), (ay * w >= y) != (by * w >= y)
        plus[k] = above & right
        minus[k] = np.where(level, reach & right, above & (right | (o == 0)))
        on[k] = (o == 0) & (np.minimum(ax, bx) * w <= x) & (x <= np.maximum(ax, bx) * w) & (np.minimum(ay, by) * w <= y) & (y <= np.maximum(ay, by) * w)

    k = np.flatnonzero(simple)
    p, q = uw[k], vw[k]
    settle(k, ux[k] * q + vx[k] * p, uy[k] * q + vy[k] * p, 2 * p * q, *(c[k] for c in (ax, ay, bx, by, level)))
    k = np.flatnonzero(~simple)
    if len(k):
        a, b, p, c, d, q, *edge = (v[k].astype(object) for v in (ux, uy, uw, vx, vy, vw, ax, ay, bx, by))
        settle(k, a * q + c * p, b * q + d * p, 2 * p * q, *edge, level[k])
    return plus, minus, on


@F.arrow_udf(_SIDES)
def _narrow_beside(
    ux: pa.Array, uy: pa.Array, uw: pa.Array, vx: pa.Array, vy: pa.Array, vw: pa.Array, level: pa.Array, ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array
) -> pa.Array:
    found = beside(*(v.to_numpy(zero_copy_only=False) for v in (ux, uy, uw, vx, vy, vw, level, ax, ay, bx, by)))
    return pa.StructArray.from_arrays([pa.array(v) for v in found], ["plus", "minus", "on"])


class Narrow:
    """Coordinates and the parts of points as BIGINTs."""

    name, point_type = "narrow", NARROW_POINT

    @staticmethod
    def integer(c: Column) -> Column:
        """``c`` as a BIGINT; raises where it is no integer below 2 ** BITS."""
        fits = (c == F.floor(c)) & (F.abs(c) < F.lit(1 << BITS))
        return F.when(c.isNull() | fits, c.cast("bigint")).otherwise(F.raise_error(F.lit("a coordinate does not fit the narrow lane")).cast("bigint"))

    @staticmethod
    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("bigint").alias("X"), y.cast("bigint").alias("Y"), F.lit(1).cast("bigint").alias("W"))

    @staticmethod
    def crossings(*ordinates: Column) -> Column:
        """Array of the points that settle where two segments of positive length meet: none, one, or the ends of an overlap."""
        return _narrow_crossings(*(c.cast("bigint") for c in ordinates))

    @staticmethod
    def pieces(ax, ay, bx, by, points: Column) -> Column:
        """Sub-segments (u, v) between consecutive distinct points of a segment, v above u (to its right if level)."""
        level = ay == by
        less = lambda p, q: F.when(level, _dec(p["X"]) * _dec(q["W"]) - _dec(q["X"]) * _dec(p["W"])).otherwise(_dec(p["Y"]) * _dec(q["W"]) - _dec(q["Y"]) * _dec(p["W"]))
        compare = lambda p, q: F.when(less(p, q) < 0, -1).when(less(p, q) > 0, 1).otherwise(0)
        s = F.array_sort(F.array_distinct(points), compare)
        return F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))

    @staticmethod
    def level(u: Column, v: Column) -> Column:
        return _dec(u["Y"]) * _dec(v["W"]) == _dec(v["Y"]) * _dec(u["W"])

    @staticmethod
    def beside(u: Column, v: Column, level: Column, ax, ay, bx, by) -> Column:
        """Whether rays to the east from just beside the midpoint of u and v cross the segment a b.

        plus starts east of it (above it where its edge is level), minus west of (below) it; ``on``
        says that it lies on the segment.
        """
        return _narrow_beside(*(p[k] for p in (u, v) for k in "XYW"), level, *(c.cast("bigint") for c in (ax, ay, bx, by)))


def _ints(s: pd.Series) -> list[int]:
    return [int(v) for v in s]


def _reduced(x: int, y: int, w: int) -> tuple[int, int, int]:
    g = math.gcd(x, y, w) * (1 if w > 0 else -1)
    return x // g, y // g, w // g


def _row(p: tuple[int, int, int]) -> dict[str, str]:
    return {"X": str(p[0]), "Y": str(p[1]), "W": str(p[2])}


def _meet(ax, ay, bx, by, cx, cy, dx, dy) -> list[tuple[int, int, int]]:
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    den, t, u = ux * vy - uy * vx, (cx - ax) * vy - (cy - ay) * vx, (cx - ax) * uy - (cy - ay) * ux
    if den:
        s = 1 if den > 0 else -1
        if 0 <= t * s <= den * s and 0 <= u * s <= den * s:
            return [_reduced(ax * den + t * ux, ay * den + t * uy, den)]
        return []
    if u:
        return []
    box = lambda p, q, x1, y1, x2, y2: min(x1, x2) <= p <= max(x1, x2) and min(y1, y2) <= q <= max(y1, y2)
    ends = [(cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by), (ax, ay, cx, cy, dx, dy), (bx, by, cx, cy, dx, dy)]
    return sorted({(e[0], e[1], 1) for e in ends if box(*e)})


@F.pandas_udf(T.ArrayType(_POINT))
def _wide_crossings(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
    return pd.Series([[_row(p) for p in _meet(*v)] for v in zip(*map(_ints, (ax, ay, bx, by, cx, cy, dx, dy)))], dtype=object)


@F.pandas_udf(T.ArrayType(_PIECE))
def _wide_pieces(level: pd.Series, points: pd.Series) -> pd.Series:
    out = []
    for flat, some in zip(level, points):
        ps = {(int(p["X"]), int(p["Y"]), int(p["W"])) for p in some}
        s = sorted(ps, key=lambda p: Fraction(p[0] if flat else p[1], p[2]))
        out.append([{"u": _row(u), "v": _row(v)} for u, v in zip(s, s[1:])])
    return pd.Series(out, dtype=object)


@F.pandas_udf(_POINT)
def _wide_midpoint(ux: pd.Series, uy: pd.Series, uw: pd.Series, vx: pd.Series, vy: pd.Series, vw: pd.Series) -> pd.DataFrame:
    rows = [_row(_reduced(a * f + d * c, b * f + e * c, 2 * c * f)) for a, b, c, d, e, f in zip(*map(_ints, (ux, uy, uw, vx, vy, vw)))]
    return pd.DataFrame(rows, columns=["X", "Y", "W"])


@F.pandas_udf(T.BooleanType())
def _wide_level(uy: pd.Series, uw: pd.Series, vy: pd.Series, vw: pd.Series) -> pd.Series:
    return pd.Series([a * d == c * b for a, b, c, d in zip(*map(_ints, (uy, uw, vy, vw)))], dtype=bool)


@F.pandas_udf(_SIDES)
def _wide_sides(x: pd.Series, y: pd.Series, w: pd.Series, level: pd.Series, ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
    out = []
    for px, py, pw, flat, x1, y1, x2, y2 in zip(*map(_ints, (x, y, w)), level, *map(_ints, (ax, ay, bx, by))):
        x1, y1, x2, y2 = x1 * pw, y1 * pw, x2 * pw, y2 * pw
        o = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        right = o > 0 if y2 > y1 else o < 0
        above, reach = (y1 > py) != (y2 > py), (y1 >= py) != (y2 >= py)
        on = o == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2)
        out.append((above and right, reach and right if flat else above and (right or o == 0), on))
    return pd.DataFrame(out, columns=["plus", "minus", "on"])


class Wide:
    """The same on integers of any size, as decimal text."""

    name, point_type = "wide", WIDE_POINT

    @staticmethod
    def integer(c: Column) -> Column:
        return c.cast("string")

    @staticmethod
    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("string").alias("X"), y.cast("string").alias("Y"), F.lit("1").alias("W"))

    @staticmethod
    def crossings(*ordinates: Column) -> Column:
        return _wide_crossings(*ordinates)

    @staticmethod
    def pieces(ax, ay, bx, by, points: Column) -> Column:
        return _wide_pieces(ay == by, points)

    @staticmethod
    def level(u: Column, v: Column) -> Column:
        return _wide_level(u["Y"], u["W"], v["Y"], v["W"])

    @staticmethod
    def beside(u: Column, v: Column, level: Column, ax, ay, bx, by) -> Column:
        m = _wide_midpoint(u["X"], u["Y"], u["W"], v["X"], v["Y"], v["W"])
        return _wide_sides(m["X"], m["Y"], m["W"], level, ax, ay, bx, by)


LANES = {"narrow": Narrow, "wide": Wide}
