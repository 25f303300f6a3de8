"""The route over witness points against the arrangement, known matrices and brute force."""

import random
from fractions import Fraction

from terrazzo.operators import relate, witness
from tests.test_geometry import RELATE, pairs


def test_known_matrices(spark):
    rows = {r.pair: r.matrix for r in witness.relate_witness(pairs(spark, [(a, b) for a, b, _ in RELATE])).collect()}
    assert [rows[i] for i in range(len(RELATE))] == [m for _, _, m in RELATE]


def shapes(seed, n):
    """Triangles, quadrangles with holes, pairs of polygons, crossing lines, closed lines and points on a small grid."""
    rng = random.Random(seed)
    xy = lambda: f"{rng.randint(0, 4)} {rng.randint(0, 4)}"

    def triangle():
        while True:
            p = [(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(3)]
            if (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) != (p[1][1] - p[0][1]) * (p[2][0] - p[0][0]):
                return "(" + ", ".join(f"{x} {y}" for x, y in [*p, p[0]]) + ")"

    def shape():
        kind = rng.randrange(7)
        if kind == 0:
            return f"POLYGON ({triangle()})"
        if kind == 1:
            return "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 2 3, 1 1))"
        if kind == 2:
            return f"GEOMETRYCOLLECTION (POLYGON ({triangle()}), POLYGON ({triangle()}))"
        if kind == 3:
            start = xy()
            return f"LINESTRING ({start}, {xy()}, {xy()}, {start})"
        if kind == 4:
            return f"MULTILINESTRING (({xy()}, {xy()}, {xy()}), ({xy()}, {xy()}))"
        if kind == 5:
            return f"MULTIPOINT ({xy()}, {xy()})"
        return f"GEOMETRYCOLLECTION (POLYGON ({triangle()}), LINESTRING ({xy()}, {xy()}), POINT ({xy()}))"

    return [(shape(), shape()) for _ in range(n)]


def test_both_routes_agree(spark):
    some = pairs(spark, shapes(5, 60))
    rows = witness.dual_agreement(some, relate.relate(some)).collect()
    assert len(rows) == 60
    assert [r for r in rows if not r.agree] == []


def test_fractions(spark):
    some = pairs(spark, [("POLYGON ((0.1 0.1, 0.7 0.2, 0.3 0.9, 0.1 0.1))", "LINESTRING (0 0.3, 0.9 0.4)"), ("POINT (1e-9 1)", "LINESTRING (0 1, 1e-8 1)"), ("POINT EMPTY", "POINT (1 2)")])
    rows = {r.pair: r for r in witness.dual_agreement(some, relate.relate(some)).collect()}
    assert all(r.agree for r in rows.values()) and rows[1].witness == "0FFFFF102"


def test_steps_meet_nothing(spark):
    """Points beside a midpoint lie between it and the nearest of all segments of a small grid."""
    rng = random.Random(2)
    size = 3
    grid = [(x, y) for x in range(-size, size + 1) for y in range(-size, size + 1)]
    for _ in range(30):
        a, b = rng.sample(grid, 2)
        (x, y, w), left, right = witness.beside_middle((*a, 1), (*b, 1), size)
        m = Fraction(x, w), Fraction(y, w)
        step = [((Fraction(p[0], p[2]) - m[0]) ** 2 + (Fraction(p[1], p[2]) - m[1]) ** 2) for p in (left, right)]
        turn = [(b[0] - a[0]) * (Fraction(p[1], p[2]) - a[1]) - (b[1] - a[1]) * (Fraction(p[0], p[2]) - a[0]) for p in (left, right)]
        assert turn[0] > 0 > turn[1] and step[0] == step[1]
        for c in grid:
            for d in grid:
                o = (d[0] - c[0]) * (m[1] - c[1]) - (d[1] - c[1]) * (m[0] - c[0])
                if c != d and o:
                    assert step[0] * ((d[0] - c[0]) ** 2 + (d[1] - c[1]) ** 2) < o * o
