"""Queries over users' lines and neighbours at any distance, by brute force."""

import os
from fractions import Fraction
from math import floor, sqrt

import pytest

from terrazzo.operators import measures
from terrazzo.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def lines(spark):
    """Each user's points, from the events themselves."""
    out = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        cents = floor(abs(r.value) * 100 + 0.5) * (1 if r.value >= 0 else -1)
        y = abs(cents) % 64 * (1 if cents >= 0 else -1)
        out.setdefault(r.user_id, []).append((r.event_id % 64, y))
    assert max(map(len, out.values())) > 12
    return out


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_ends(spark, lines):
    want = {(k, *p) for k, v in lines.items() if v[0] != v[-1] for p in (v[0], v[-1])}
    out = run(spark, "line_ends")
    assert len(out) == len(want) and {(r.k, r.x, r.y) for r in out} == want


def test_lengths(spark, lines):
    want = {k: sum(sqrt((a - c) ** 2 + (b - d) ** 2) for (a, b), (c, d) in zip(v, v[1:])) for k, v in lines.items()}
    out = {r.id: r.length for r in run(spark, "line_lengths")}
    assert out.keys() == want.keys() and all(abs(out[k] - 1000 * want[k]) <= 0.501 for k in want)


def test_hulls(spark, lines):
    """A corner has all other points on one side of some line through it: no two others enclose it."""

    def corner(p, pts):
        at = [(x - p[0], y - p[1]) for x, y in pts if (x, y) != p]
        # strictly inside a half plane, or on its border on one side of p only
        return any(all((c := u[0] * v[1] - u[1] * v[0]) > 0 or (c == 0 and u[0] * v[0] + u[1] * v[1] > 0) for v in at) for u in at) or not at

    want = {(k, *p) for k, v in lines.items() for p in set(v) if corner(p, set(v))}
    out = run(spark, "line_hulls")
    assert len(out) == len(want) and {(r.id, r.x, r.y) for r in out} == want


def test_boxes(spark, lines):
    boxes = {r.k: (r.x1, r.y1, r.x2, r.y2) for r in queries.boxes(spark, SF).collect()}
    want = {}
    for k, v in lines.items():
        if k not in boxes:
            continue
        x1, y1, x2, y2 = boxes[k]

        def loc(p):
            inside = x1 <= p[0] <= x2 and y1 <= p[1] <= y2
            return "E" if not inside else "I" if x1 < p[0] < x2 and y1 < p[1] < y2 else "B"

        ends = set() if v[0] == v[-1] else {v[0], v[-1]}
        dims = {}
        for (a, b), (c, d) in zip(v, v[1:]):
            cuts = {Fraction(0), Fraction(1)}
            cuts |= {Fraction(w - p, q - p) for p, q, ws in ((a, c, (x1, x2)), (b, d, (y1, y2))) if p != q for w in ws}
            cuts = sorted(t for t in cuts if 0 <= t <= 1)
            at = lambda t: (a + t * (c - a), b + t * (d - b))
            found = [("I", loc(at((s + t) / 2)), 1) for s, t in zip(cuts, cuts[1:]) if (a, b) != (c, d)]
            found += [("B" if at(t) in ends else "I", loc(at(t)), 0) for t in cuts]
            for la, lb, n in found:
                dims[la + lb] = max(n, dims.get(la + lb, 0))
        want[k] = "".join(str(dims.get(i + j, "F")) for i in "IB" for j in "IBE") + "212"
    assert {r.pair: r.matrix for r in run(spark, "line_boxes")} == want


def test_nearest(spark):
    def brute(p):
        d = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
        return {(a[0], *min((b[0], d(a, b)) for b in p if b[0] != a[0] and d(a, b) == min(d(a, c) for c in p if c[0] != a[0]))) for a in p}

    p = [(r.k, r.x, r.y) for r in queries.points(spark, SF).collect()]
    assert {(r.left_id, r.right_id, r.distance2) for r in run(spark, "nearest_points")} == brute(p)
    far = [(1, 0, 0), (2, 1, 0), (3, 1000, 0), (4, 1000, 5000), (5, -7, -90)]
    frame = spark.createDataFrame(far, "id bigint, x bigint, y bigint")
    assert {(r.left_id, r.right_id, r.distance2) for r in measures.nearest_other(frame, 12.0).collect()} == brute(far)
    assert measures.nearest_other(frame.where("id = 1"), 12.0).count() == 0 and measures.nearest_other(frame.where("id = 0"), 12.0).count() == 0
