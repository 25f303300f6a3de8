"""Canonical forms: one for all ways of writing a geometry."""

import random

from pyspark.sql import functions as F

from terrazzo.functions import canonical, geometry as g

SAME = [
    ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1), (3 3, 3 2, 2 3, 3 3))", "POLYGON ((4 4, 4 0, 0 0, 0 4, 4 4), (3 2, 3 3, 2 3, 3 2), (1 1, 2 2, 1 2, 1 1))"],
    ["LINESTRING (3 1, 2 2, 0 5)", "LINESTRING (0 5, 2 2, 3 1)"],
    ["MULTIPOINT (3 1, -0 2, 0 1)", "MULTIPOINT (0 1, 3 1, 0 2)"],
    ["GEOMETRYCOLLECTION (POINT (1 1), GEOMETRYCOLLECTION (LINESTRING (1 0, 0 0)))", "GEOMETRYCOLLECTION (LINESTRING (0 0, 1 0), POINT (1 1))"],
    ["MULTIPOLYGON (((5 5, 6 5, 5 6, 5 5)), ((0 0, 1 0, 0 1, 0 0)))", "MULTIPOLYGON (((0 1, 1 0, 0 0, 0 1)), ((5 6, 6 5, 5 5, 5 6)))"],
    ["POLYGON ((0 0, 1 1, 2 0, 0 0, -1 3, -2 1, 0 0))", "POLYGON ((0 0, -1 3, -2 1, 0 0, 1 1, 2 0, 0 0))"],  # its least vertex is not the repeated one
    ["POLYGON ((0 0, 3 1, 3 2, 0 0, 2 4, 1 4, 0 0))", "POLYGON ((0 0, 2 4, 1 4, 0 0, 3 1, 3 2, 0 0))"],  # the least vertex twice
    ["POLYGON ((0 0, 2 2, 1 1, 0 0))", "POLYGON ((1 1, 2 2, 0 0, 1 1))"],  # flat
    ["POINT EMPTY"], ["POLYGON EMPTY"], ["GEOMETRYCOLLECTION EMPTY"], ["POINT (1 1)"], ["MULTIPOINT (1 1)"],
]


def test_one_digest_each(spark):
    rows = [(k, t) for k, some in enumerate(SAME) for t in some]
    table = spark.createDataFrame(rows, "k int, t string").withColumn("geom", g.st_geomfromtext("t"))
    got = {}
    for r in table.select("k", canonical.geometry_digest(F.col("geom")).alias("d")).collect():
        got.setdefault(r.k, set()).add(r.d)
    assert all(len(v) == 1 for v in got.values())
    assert len(set.union(*got.values())) == len(SAME)


def test_forms(spark):
    table = spark.createDataFrame([(SAME[0][1],), (SAME[1][0],), ("MULTIPOINT (3 1, 0 1)",)], "t string").select(canonical.canonicalize(g.st_geomfromtext("t")).alias("geom"))
    table = spark.createDataFrame(table.collect(), table.schema)
    assert [r.t for r in table.select(g.st_astext("geom").alias("t")).collect()] == [
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1), (2 3, 3 3, 3 2, 2 3))", "LINESTRING (0 5, 2 2, 3 1)", "MULTIPOINT ((0 1), (3 1))",
    ]


def test_rotations_and_reversals(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        ring = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(rng.randint(3, 7))]
        for _ in range(4):
            i = rng.randrange(len(ring))
            turned = ring[i:] + ring[:i]
            turned = turned[::-1] if rng.random() < 0.5 else turned
            rows.append((k, "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*turned, turned[0]]) + "))"))
    table = spark.createDataFrame(rows, "k int, t string").select("k", canonical.geometry_digest(g.st_geomfromtext("t")).alias("d"))
    assert {r.n for r in table.groupBy("k").agg(F.count_distinct("d").alias("n")).collect()} == {1}
    assert table.select("d").distinct().count() == 40


def test_parts_and_coordinates(spark):
    text = "GEOMETRYCOLLECTION (POINT (1 1), POINT EMPTY, LINESTRING (0 0, 1 0), MULTIPOINT (2 2, 3 3), POLYGON ((0 0, 1 0, 0 1, 0 0)))"
    row = spark.createDataFrame([(text,)], "t string").select(g.st_geomfromtext("t").alias("geom")).select(*(F.size(canonical.elements_of(F.col("geom"), k)).alias(f"n{k}") for k in range(3))).first()
    assert tuple(row) == (3, 1, 1)
    pair = spark.createDataFrame([((0.0, 1.0), (-0.0, 1.0)), ((float("nan"), 1.0), (float("nan"), 1.0))], "p struct<x:double,y:double>, q struct<x:double,y:double>")
    assert [r.s for r in pair.select(canonical.same_xy(F.col("p"), F.col("q")).alias("s")).collect()] == [True, False]
