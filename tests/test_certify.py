"""Certificates accept what the overlay builds and catch what is planted."""

from pyspark.sql import functions as F

from terrazzo.operators import certify, overlay
from tests.test_geometry import pairs
from tests.test_witness import shapes

SQUARES = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"


def test_built_results_pass(spark):
    """Polygons with holes, collections, Mod-2 lines and points, and crossings at fractions, under all operations."""
    some = pairs(spark, [*shapes(7, 24), ("POLYGON ((0 0, 7 1, 3 5, 0 0))", "POLYGON ((1 3, 6 0, 5 4, 1 3))"), ("POLYGON ((0.1 0, 0.7 0.2, 0.3 0.9, 0.1 0))", "LINESTRING (0 0.3, 0.9 0.4)")]).persist()
    made = [(r.pair, n, r.exact) for n in overlay.OPERATIONS for r in overlay.overlay_geometry(some, n).collect()]
    rows = certify.certify(some, spark.createDataFrame(made, "pair int, op string, exact string")).collect()
    assert len(rows) == 4 * 26
    assert [(r.pair, r.op, r.first) for r in rows if not r.ok] == []
    assert all(r.faces >= 2 * r.edges for r in rows)


def test_areal_results_pass(spark):
    rows = certify.overlay_certified(pairs(spark, shapes(8, 15)), "union", areal=True).collect()
    assert [(r.pair, r.exact, r.first) for r in rows if not r.ok] == []


PLANTED = [  # intersection of the squares: right, then wrong ones
    ("POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))", True),
    ("POLYGON ((2 2, 4 2, 4 4, 2 2))", False),
    ("POLYGON ((2 2, 4 2, 4 4, 2 4000001/1000000, 2 2))", False),
    ("POLYGON EMPTY", False),
    ("GEOMETRYCOLLECTION (POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2)), POINT (5/3 1))", False),
    ("GEOMETRYCOLLECTION (POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2)), LINESTRING (4 4, 5 5))", False),
    ("POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2), (3 3, 10/3 3, 3 10/3, 3 3))", False),
    ("MULTIPOLYGON (((2 2, 3 2, 3 4, 2 4, 2 2)), ((3 2, 4 2, 4 4, 3 4, 3 2)))", True),  # the same points
    ("LINESTRING (2 2, 4 2, 4 4, 2 4, 2 2)", False),
]


def test_planted_results_are_caught(spark):
    some = pairs(spark, [SQUARES] * len(PLANTED))
    made = spark.createDataFrame([(k, "intersection", t) for k, (t, _) in enumerate(PLANTED)], "pair int, op string, exact string")
    rows = {r.pair: r for r in certify.certify(some, made).collect()}
    assert [rows[k].ok for k in range(len(PLANTED))] == [ok for _, ok in PLANTED]
    assert rows[3].first.expected in "IB" and rows[3].first.found == "E"


def test_every_operation_against_every_result(spark):
    """A result passes for its own operation and for no other."""
    some = pairs(spark, [SQUARES])
    made = {n: overlay.overlay_geometry(some, n).first().exact for n in overlay.OPERATIONS}
    table = [(k, n, t) for k, t in enumerate(made.values()) for n in made]
    asked = spark.createDataFrame([(k,) for k in range(4)], "pair int").crossJoin(some.drop("pair"))
    rows = {(r.pair, r.op): r.ok for r in certify.certify(asked, spark.createDataFrame(table, "pair int, op string, exact string")).collect()}
    assert rows == {(k, n): own == n for k, own in enumerate(made) for n in made}


def test_exact_texts(spark):
    rows = spark.createDataFrame([("GEOMETRYCOLLECTION (POINT (1/3 -2/7), LINESTRING (0 0, 0.5 1e1))",)], "t string")
    out = rows.select(F.explode(certify.exact_coordinates("t")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in out] == [(0, 0, 0, 0, "1/3", "-2/7", None, None), (1, 1, 0, 0, "0", "0", "1/2", "10"), (1, 1, 0, 1, "1/2", "10", None, None)]
