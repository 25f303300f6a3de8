"""Deterministic near-degenerate cases, one family a query over a range of ids.

Every random number is a hash of (seed, family, id, place), so a case is the same whatever the
partitions, and a family of any size is generated where its rows are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrazzo.functions.exact import nudge
from terrazzo.functions.geometry import ELEMENT, LINE, POINT, POLYGON



def _element(kind: int, rings: list[list[tuple]], path: tuple[int, ...] = ()) -> Column:
    xy = lambda p: F.struct(*(( c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for n, c in zip("xy", p)))
    cols = [F.array(*map(xy, r)) for r in rings]
    kinds = "array<array<struct<x:double,y:double>>>"
    return F.struct(F.array(*map(F.lit, path)).cast("array<int>").alias("path"), F.lit(kind).alias("kind"), (F.array(*cols) if cols else F.array().cast(kinds)).cast(kinds).alias("rings"))


def geometry(name: str, *elements: Column) -> Column:
    parts = F.array(*elements) if elements else F.array().cast(f"array<{ELEMENT}>")
    return F.struct(F.lit(name).alias("type"), parts.alias("elements"))


def polygon(*rings: list[tuple]) -> Column:
    return geometry("Polygon", _element(POLYGON, [[*r, r[0]] for r in rings]))


def line(*points: tuple) -> Column:
    return geometry("LineString", _element(LINE, [list(points)]))


def point(x, y) -> Column:
    return geometry("Point", _element(POINT, [[(x, y)]]))


def multi(name: str, kind: int, *parts: list[list[tuple]]) -> Column:
    return geometry(name, *(_element(kind, p, (i,)) for i, p in enumerate(parts)))


class Dice:
    """Numbers of one case."""

    def __init__(self, family: str, seed: int):
        self.family, self.seed, self.n = family, seed, 0

    def __call__(self, low: int, high: int) -> Column:
        """A whole number from ``low`` to ``high``."""
        self.n += 1
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.family), F.lit(self.n), F.col("n")), F.lit(high - low + 1)) + low


def _box(x, y, w, h) -> list[tuple]:
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def _int_grid(d: Dice):
    a, b = ([d(0, 8), d(0, 8), d(1, 6), d(1, 6)] for _ in "ab")
    return polygon(_box(*a)), polygon(_box(*b))


def _shared_edge(d: Dice):
    x, y, w, h, k = d(0, 9), d(0, 9), d(1, 9), d(2, 9), d(0, 3)
    return polygon(_box(x, y, w, h)), polygon(_box(x + w, y + k - 1, d(1, 5), d(1, 9)))


def _vertex_on_edge(d: Dice):
    x, y, p, q, m, k = d(-9, 9), d(-9, 9), d(1, 7), d(1, 7), d(2, 6), d(1, 9)
    on = (x + p * F.least(m - 1, F.lit(1) + k % m), y + q * F.least(m - 1, F.lit(1) + k % m))
    return polygon([(x, y), (x + p * m, y + q * m), (x - q * m, y + p * m)]), polygon([on, (on[0] + q + 1, on[1] - p), (on[0] + q + 2, on[1] - p + 1)])


def _near_collinear(d: Dice):
    x, y = d(1, 99) / F.lit(10.0), d(1, 99) / F.lit(10.0)
    u, v = x + d(1, 30) / F.lit(7.0), y + d(1, 30) / F.lit(7.0)
    mx, my = nudge((x + u) / 2, d(-3, 3)), nudge((y + v) / 2, d(-3, 3))
    return polygon([(x, y), (u, v), (x - 1, y + 1)]), polygon([(mx, my), (mx + 2, my - 1), (mx + 2, my + F.lit(0.25))])


def _tiny_transform(d: Dice):
    x, y, w, h = d(0, 9) / F.lit(10.0), d(0, 9) / F.lit(10.0), d(1, 9) / F.lit(3.0), d(1, 9) / F.lit(3.0)
    k = d(1, 4)
    return polygon(_box(x, y, w, h)), polygon([(nudge(px, k), nudge(py, -k)) for px, py in _box(x, y, w, h)])


def _sliver_spike(d: Dice):
    x, y, w, k = d(0, 9), d(0, 9), d(2, 9), d(20, 45)
    thin = F.pow(F.lit(2.0), -k)
    return polygon([(x, y), (x + w, y), (x + w, y + w), (x + w / 2 + thin, y + w), (x + w / 2, y + 2 * w), (x + w / 2 - thin, y + w), (x, y + w)]), polygon(_box(x, y + w, w, d(1, 9)))


def _hole_contact(d: Dice):
    x, y, k = d(0, 9), d(0, 9), d(0, 2)
    hole = _box(x + 2, y + 2, F.lit(4), F.lit(4))
    return polygon(_box(x, y, F.lit(9), F.lit(9)), hole[::-1]), polygon(_box(x + 2, y + 2, F.lit(4) - k, F.lit(4)))


def _multi_touch(d: Dice):
    x, y, w, v = d(0, 9), d(0, 9), d(1, 5), d(1, 5)
    ring = lambda b: [[*b, b[0]]]
    return multi("MultiPolygon", POLYGON, ring(_box(x, y, w, w)), ring(_box(x + w, y + w, v, v))), polygon(_box(x + w - 1, y + w, d(1, 3), d(1, 3)))


def _tiling_contact(d: Dice):
    i, j, s = d(0, 20), d(0, 20), d(1, 9) / F.lit(10.0)
    return polygon(_box(i * s, j * s, s, s)), polygon([((i + 1) * s, j * s), ((i + 2) * s, j * s), ((i + 2) * s, (j + 1) * s), ((i + 1) * s, (j + 1) * s)])


def _line_line(d: Dice):
    x, y, p, q = d(0, 9), d(0, 9), d(-4, 4), d(1, 4)
    a, b, c = d(0, 3), d(2, 5), d(0, 4)
    return line((x, y), (x + 3 * p, y + 3 * q)), line((x + a * p, y + a * q), (x + b * p + 2 * a, y + b * q + 1), (x + c * p, y + c * q))


def _line_mod2(d: Dice):
    x, y = d(0, 9), d(0, 9)
    arms = [[[(x, y), (x + d(1, 5), y + d(-5, 5))]] for _ in range(3)]
    return multi("MultiLineString", LINE, *arms), point(x, y)


def _point_geometry(d: Dice):
    x, y, w = d(0, 9), d(0, 9), d(1, 6)
    return point(x + d(-1, 7), y + d(-1, 7)), polygon(_box(x, y, w, w))


def _line_polygon(d: Dice):
    x, y, w = d(0, 9), d(0, 9), d(2, 6)
    return line((x + d(-2, 7), y + d(-2, 7)), (x + w, y + d(0, 2)), (x + d(-2, 7), y + w)), polygon(_box(x, y, w, w))


def _gc(d: Dice):
    x, y, w = d(0, 9), d(0, 9), d(1, 6)
    ring = lambda b: [[*b, b[0]]]
    parts = [_element(POLYGON, ring(_box(x, y, w, w)), (0,)), _element(POLYGON, ring(_box(x + w, y, w, w)), (1,)), _element(POINT, [[(x - 5, y)]], (2,)), _element(LINE, [[(x, y - 3), (x + w, y - 3 + d(0, 4))]], (3,))]
    return geometry("GeometryCollection", *parts), polygon(_box(x + w - 1, y, F.lit(2), w))


def _empty(d: Dice):
    empties = [geometry("Point", _element(POINT, [])), geometry("LineString", _element(LINE, [])), geometry("Polygon", _element(POLYGON, [])), geometry("GeometryCollection")]
    k = d(0, 3)
    chosen = F.when(k == 0, empties[0]).when(k == 1, empties[1]).when(k == 2, empties[2]).otherwise(empties[3])
    return chosen, polygon(_box(d(0, 9), d(0, 9), d(1, 6), d(1, 6)))


def _zero_length(d: Dice):
    x, y = d(0, 9), d(0, 9)
    return line((x, y), (x, y), (x, y)), polygon(_box(d(0, 6), d(0, 6), d(1, 6), d(1, 6)))


#: Names of the families.
FAMILIES = {
    "near-collinear": _near_collinear, "vertex-on-edge": _vertex_on_edge, "shared-edge": _shared_edge, "tiny-transform": _tiny_transform, "sliver-spike": _sliver_spike,
    "hole-contact": _hole_contact, "multi-touch": _multi_touch, "tiling-contact": _tiling_contact, "int-grid": _int_grid, "line-line": _line_line, "line-mod2": _line_mod2,
    "point-geometry": _point_geometry, "line-polygon": _line_polygon, "gc": _gc, "empty": _empty, "invalid-zero-length-line": _zero_length,
}


def generate(spark: SparkSession, family: str, n: int, seed: int = 1) -> DataFrame:
    """(pair, family, a, b) of ``n`` cases; ids read family-seed-number. Family ``scaled`` scales the others by powers of two."""
    rows = spark.range(n).withColumnRenamed("id", "n")
    if family == "scaled":
        from terrazzo.functions.geometry import st_mapcoords

        names = sorted(FAMILIES)
        parts = [generate(spark, f, -(-n // len(names)), seed).withColumn("_k", F.pmod(F.xxhash64("pair"), F.lit(1200)) - 600) for f in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        by = F.pow(F.lit(2.0), F.col("_k"))
        grow = lambda c: st_mapcoords(F.col(c), lambda x, y: (x * by, y * by)).alias(c)
        return out.select(F.concat(F.lit("scaled-"), "pair").alias("pair"), F.lit(family).alias("family"), grow("a"), grow("b"))
    a, b = FAMILIES[family](Dice(family, seed))
    name = F.concat(F.lit(f"{family}-{seed}-"), F.lpad(F.col("n").cast("string"), 6, "0"))
    return rows.select(name.alias("pair"), F.lit(family).alias("family"), a.alias("a"), b.alias("b"))


def corpus(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` cases of every family, the same geometry pair once only."""
    out = None
    for family in [*FAMILIES, "scaled"]:
        part = generate(spark, family, n, seed)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("_d", F.sha2(F.to_json(F.struct("a", "b")).cast("binary"), 256)).dropDuplicates(["_d"]).drop("_d")
