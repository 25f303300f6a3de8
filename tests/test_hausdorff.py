"""Hausdorff distances against known values and against dense samples in plain fractions."""

import random
from fractions import Fraction as Q

from pyspark.sql import functions as F

from terrazzo.operators import hausdorff
from tests.test_geometry import pairs

KNOWN = [
    ("POINT (0 0)", "POINT (3 4)", "25"),
    ("MULTIPOINT (0 0, 10 0)", "POINT (0 1)", "101"),
    ("LINESTRING (0 0, 10 0)", "MULTIPOINT (0 0, 10 0)", "25"),  # the middle of the line
    ("LINESTRING (0 0, 10 0)", "LINESTRING (0 1, 10 1)", "1"),
    ("POLYGON ((0 0, 8 0, 8 8, 0 8, 0 0))", "POLYGON ((1 1, 7 1, 7 7, 1 7, 1 1))", "2"),
    ("LINESTRING (0 0, 6 0)", "MULTIPOINT (0 2, 6 2, 3 9)", "81"),
    ("LINESTRING (0 0, 6 0)", "MULTIPOINT (0 2, 6 2)", "13"),  # the place equally far from both points
    ("LINESTRING (1 1, 1 1)", "POINT (1 1)", "0"),
    ("POINT EMPTY", "POINT (1 1)", None),
]


def test_known(spark):
    rows = {r.pair: r for r in hausdorff.hausdorff2(pairs(spark, [(a, b) for a, b, _ in KNOWN])).collect()}
    assert [rows[k].lo for k in range(len(KNOWN))] == [d for *_, d in KNOWN] == [rows[k].hi for k in range(len(KNOWN))]


def test_samples(spark):
    """No sampled place is farther than the upper end, and the lower end is reached closely."""
    rng = random.Random(4)
    line = lambda: [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(2, 4))]
    some = []
    while len(some) < 25:
        a, b = line(), line()
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            some.append((a, b))
    text = lambda l: "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in l) + ")"
    rows = {r.pair: r for r in hausdorff.hausdorff2(pairs(spark, [(text(a), text(b)) for a, b in some])).collect()}
    for k, (a, b) in enumerate(some):
        most = 0.0
        for s, o in ((a, b), (b, a)):
            other = [(*p, *q) for p, q in zip(o, o[1:])]
            for p, q in zip(s, s[1:]):
                for i in range(301):
                    at = (p[0] + (q[0] - p[0]) * i / 300, p[1] + (q[1] - p[1]) * i / 300)
                    most = max(most, min(hausdorff.point_distance2(at, f) for f in other))
        lo, hi = Q(rows[k].lo), Q(rows[k].hi)
        assert lo <= hi and float(hi - lo) < 1e-30
        assert most <= float(hi) + 1e-9 and float(lo) <= (most**0.5 + 13 / 600) ** 2 + 1e-9, (a, b)


def test_empty_table(spark):
    assert hausdorff.hausdorff2(pairs(spark, [("POINT (0 0)", "POINT (1 1)")]).where(F.lit(False))).count() == 0
