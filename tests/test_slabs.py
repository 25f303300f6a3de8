"""The slab route against the arrangement and against areas worked out by hand."""

from fractions import Fraction

from pyspark.sql import functions as F

from terrazzo.operators import overlay, slabs
from tests.test_geometry import pairs
from tests.test_witness import shapes


def test_areas_equal_the_arrangement(spark):
    """Triangles, frames, lines and points (no area) and fractions."""
    some = [(a, b) for a, b in shapes(3, 60) if not any(t.startswith("GEOMETRYCOLLECTION (POLYGON") and t.count("POLYGON") > 1 for t in (a, b))]
    some += [("POLYGON ((0.1 0.1, 0.7 0.2, 0.3 0.9, 0.1 0.1))", "POLYGON ((0 0.3, 0.9 0.4, 0.2 0.5, 0 0.3))"), ("POINT EMPTY", "POINT (1 2)")]
    table = pairs(spark, some).persist()
    by_slabs = {(r.pair, r.op): r.area for r in slabs.overlay_areas(table).collect()}
    assert by_slabs == {(r.pair, r.op): r.area for r in overlay.overlay(table).collect()} and len(by_slabs) == 4 * len(some)


RINGS = {
    "bow-tie": ([(0, 0), (4, 4), (4, 0), (0, 4)], "8"),
    "square": ([(0, 0), (4, 0), (4, 4), (0, 4)], "16"),
    "pentagram": ([(0, 0), (6, 0), (1, 5), (3, -3), (5, 5)], None),
    "there and back": ([(0, 0), (3, 2)], "0"),
}


def even_odd(ring):
    """By scan lines through every abscissa where edges end or meet, in plain fractions."""
    edges = [(p, q) for p, q in zip(ring, ring[1:] + ring[:1])]
    xs = {Fraction(p[0]) for p in ring}
    for (a, b) in edges:
        for (c, d) in edges:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = Fraction((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), den)
                xs.add(a[0] + t * (b[0] - a[0]))
    total, xs = Fraction(0), sorted(xs)
    for l, r in zip(xs, xs[1:]):
        m = (l + r) / 2
        ys = sorted(a[1] + Fraction(b[1] - a[1]) * (m - a[0]) / (b[0] - a[0]) for a, b in edges if a[0] != b[0] and min(a[0], b[0]) < m < max(a[0], b[0]))
        total += sum((v - u) * (r - l) for u, v in zip(ys[::2], ys[1::2]))
    return total


def test_rings_that_cross(spark):
    rows = [(name, *p, *q) for name, (ring, _) in RINGS.items() for p, q in zip(ring, ring[1:] + ring[:1])]
    rows += [("nothing", 1, 1, 1, 1)]
    edges = spark.createDataFrame(rows, "id string, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    got = {r.id: r.area for r in slabs.even_odd_area(edges).collect()}
    assert got.pop("nothing") == "0"
    for name, (ring, area) in RINGS.items():
        assert Fraction(got[name]) == even_odd(ring) and (area is None or got[name] == area), name
    assert slabs.even_odd_area(edges.where(F.lit(False))).count() == 0
