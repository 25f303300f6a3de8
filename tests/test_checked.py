"""Pairs that get no matrix, and large pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrazzo.operators import measures, noding, relate
from tests.test_geometry import SQUARE, pairs

REFUSED = [
    ("POINT (1 1)", SQUARE, "ok"),
    ("POINT (1 1)", "POLYGON ((0 0, 10 0, 10 10, 0 10))", "invalid_b: ring_not_closed"),
    ("POLYGON ((0 0, 4 4, 2 2, 0 0))", SQUARE, "invalid_a: self_intersection"),  # flat
    ("POLYGON ((0 0, 4 0, 0 0))", SQUARE, "invalid_a: too_few_points"),
    ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", SQUARE, "invalid_a: self_intersection"),
    (SQUARE, "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (10 10, 11 10, 11 11, 10 10))", "invalid_b: hole_outside_shell"),
    ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0)), ((1 1, 2 1, 2 2, 1 1)))", "POINT (0 0)", "invalid_a: nested_shells"),
    ("GEOMETRYCOLLECTION (POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0)), POLYGON ((1 1, 2 1, 2 2, 1 1)))", "POINT (0 0)", "ok"),
    ("LINESTRING (0 0, inf 1)", SQUARE, "invalid_a: invalid_coordinate"),
    ("LINESTRING (1 1, 1 1)", SQUARE, "ok"),
    ("POINT EMPTY", "POLYGON EMPTY", "ok"),
]


def test_refused_pairs(spark):
    table = pairs(spark, [(a, b) for a, b, _ in REFUSED])
    rows = {r.pair: r for r in relate.relate_checked(table).collect()}
    assert [rows[i].status for i in range(len(REFUSED))] == [s for _, _, s in REFUSED]
    assert all((r.matrix is None) == (r.status != "ok") for r in rows.values())
    sound = table.where(F.col("pair").isin([i for i, r in enumerate(REFUSED) if r[2] == "ok"]))
    assert {(r.pair, r.matrix) for r in relate.relate(sound).collect()} == {(r.pair, r.matrix) for r in rows.values() if r.status == "ok"}


def comb(teeth, turned):
    """A comb of long teeth; one turned by a right angle crosses all teeth of one that is not."""
    line = [(0, 0), (4 * teeth, 0)]
    for t in range(teeth, 0, -1):
        line += [(4 * t, 100), (4 * t - 2, 100), (4 * t - 2, 1), (4 * t - 4, 1)]
    line = [*line[:-1], (0, 1), (0, 0)]
    return "POLYGON ((" + ", ".join(f"{y if turned else x} {x if turned else y}" for x, y in line) + "))"


def star(n, seed, shift=0):
    rng = random.Random(seed)
    at = [(shift + 50_000 + int(r * math.cos(2 * math.pi * i / n)), 50_000 + int(r * math.sin(2 * math.pi * i / n))) for i in range(n) for r in (rng.randint(5_000, 50_000),)]
    return "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*at, at[0]]) + "))"


def test_pairs_over_budget(spark):
    table = pairs(spark, [(comb(12, False), comb(12, True)), (SQUARE, "LINESTRING (-1 1, 3 1)"), (SQUARE, SQUARE)])
    rows = {r.pair: (r.matrix is None, r.status) for r in relate.relate_checked(table, budget=150).collect()}
    assert rows == {0: (True, "engine_skipped"), 1: (False, "ok"), 2: (False, "ok")}


def test_slabs_change_nothing(spark, monkeypatch):
    """Stars and combs of many segments: one slab or many, the same matrices, and each pair of segments once."""
    from terrazzo.operators import model

    table = pairs(spark, [(star(80, 1), star(90, 2, 7000)), (comb(5, False), comb(6, True)), (star(40, 3), "MULTIPOINT (50000 50000, 0 0, 60000 50000)")]).persist()
    got = []
    for size in (4, 16, 10**6):
        monkeypatch.setattr(model, "SLAB_SEGMENTS", size)
        got.append(sorted((r.pair, r.matrix) for r in relate.relate(table).collect()))
        segs = model.segments(model.on_grid(model.coordinates(table), noding.LANES["narrow"]))
        met = noding.candidate_pairs(segs, noding.LANES["narrow"]).select("pair", "s", "t")
        got[-1].append(met.count())
        assert met.distinct().count() == got[-1][-1]
    assert got[0] == got[1] == got[2]


def test_even_odd_refuses_crossings(spark):
    ring = [(0, 0), (4, 4), (4, 0), (0, 4)]
    edges = spark.createDataFrame([(1, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])], "id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    with pytest.raises(ValueError, match="no end of both"):
        measures.even_odd_area(edges)
