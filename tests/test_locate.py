"""Locations against brute force in rational arithmetic."""

import random
from fractions import Fraction as Q

from pyspark.sql import functions as F

from terrazzo.functions import geometry as g
from terrazzo.operators import locate


def on(p, a, b):
    return (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def inside(p, rings):
    odd = False
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + Q(b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]):
                odd = not odd
    return odd


def where(p, polygons, lines, points):
    """(loc, dim), the sectors around a point sampled in all directions that edges between small integers can separate."""
    rims = [r for r in polygons if any(on(p, a, b) for ring in r for a, b in zip(ring, ring[1:]))]
    if any(inside(p, r) for r in polygons if r not in rims):
        return "I", 2
    if rims:
        if len(rims) > 1:
            step = Q(1, 10**6)
            around = [(x, y) for x in range(-40, 41) for y in range(-40, 41) if max(abs(x), abs(y)) == 40]
            near = [(p[0] + step * (x + Q(1, 7)), p[1] + step * (y + Q(1, 11))) for x, y in around]
            if all(any(inside(q, r) for r in polygons) for q in near):
                return "I", 2
        return "B", 2
    ends = [e for l in lines for e in (l[0], l[-1])]
    if ends.count(p) % 2:
        return "B", 1
    if any(on(p, a, b) for l in lines for a, b in zip(l, l[1:])):
        return "I", 1
    return ("I", 0) if p in points else ("E", -1)


def text(polygons, lines, points):
    path = lambda r: "(" + ", ".join(f"{float(x)} {float(y)}" for x, y in r) + ")"
    parts = ["POLYGON (" + ", ".join(map(path, p)) + ")" for p in polygons] + [f"LINESTRING {path(l)}" for l in lines] + [f"POINT ({float(x)} {float(y)})" for x, y in points]
    return "GEOMETRYCOLLECTION (" + ", ".join(parts) + ")" if parts else "GEOMETRYCOLLECTION EMPTY"


def cases(seed, n, unit):
    rng = random.Random(seed)
    xy = lambda: (rng.randint(0, 6) * unit, rng.randint(0, 6) * unit)

    def ring():
        while True:
            a, b, c = xy(), xy(), xy()
            if (b[0] - a[0]) * (c[1] - a[1]) != (b[1] - a[1]) * (c[0] - a[0]):
                return [a, b, c, a]

    box = lambda x, y, w: [(x * unit, y * unit), ((x + w) * unit, y * unit), ((x + w) * unit, (y + w) * unit), (x * unit, (y + w) * unit), (x * unit, y * unit)]
    out = []
    for k in range(n):
        polygons = [[ring()] for _ in range(rng.randint(0, 4))]
        if k % 3 == 0:  # neighbours that fill a corner together, and one with a hole
            polygons += [[box(0, 0, 3)], [box(3, 0, 3)], [box(0, 3, 3)], [box(3, 3, 3), box(4, 4, 1)]][: rng.randint(2, 4)]
        lines = [[xy() for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(0, 3))] + ([[xy()] * 2] if k % 4 == 0 else [])
        out.append((polygons, lines, [xy() for _ in range(rng.randint(0, 2))]))
    return out


def check(spark, some, unit):
    at = [(x * unit / 2, y * unit / 2) for x in range(-1, 14) for y in range(-1, 14)]
    geoms = spark.createDataFrame([(k, text(*c)) for k, c in enumerate(some)], "key int, t string").select("key", g.st_geomfromtext("t").alias("geom"))
    points = spark.createDataFrame([(k, i, float(x), float(y)) for k in range(len(some)) for i, (x, y) in enumerate(at)], "key int, id int, x double, y double")
    got = {(r.key, r.id): (r.loc, r.dim) for r in locate.locate(points, geoms).collect()}
    assert len(got) == len(some) * len(at)
    for k, c in enumerate(some):
        for i, p in enumerate(at):
            assert got[k, i] == where(p, *c), (k, c, p)


def test_collections_against_brute_force(spark):
    check(spark, cases(1, 14, Q(2)) + [([], [], [])], Q(2))


def test_on_the_wide_lane(spark):
    check(spark, cases(2, 8, Q(1, 8)), Q(1, 8))


def test_sectors():
    ring = lambda e, *d: [(e, *x) for x in d]
    assert not locate.covered_all_round(ring(0, (1, 0), (0, 1)), {0})
    assert locate.covered_all_round(ring(0, (1, 0), (-1, 0)) + ring(1, (-1, 0), (1, 0)), {0})
    assert locate.covered_all_round(ring(0, (0, 1), (0, -1)) + ring(1, (0, 1), (0, -1)), {0})
    assert not locate.covered_all_round(ring(0, (1, 0), (-1, 0)) + ring(1, (-1, 0), (0, -1)), {0})
    assert locate.covered_all_round(ring(0, (1, 0), (-1, 1)) + ring(1, (-1, 2), (0, -1)) + ring(2, (0, -5), (2, 0)), {0})


def test_empty_tables(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0)], "key int, id int, x double, y double")
    geoms = spark.createDataFrame([(1, "POLYGON EMPTY"), (2, "POINT (0 0)")], "key int, t string").select("key", g.st_geomfromtext("t").alias("geom"))
    assert [tuple(r) for r in locate.locate(points, geoms).collect()] == [(1, 1, "E", -1)]
    assert locate.locate(points.where(F.lit(False)), geoms).count() == 0
