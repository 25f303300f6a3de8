import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from terrazzo.functions import geometry as g, kernels
from terrazzo.functions.exact import nearest_double, sqrt_bounds
from terrazzo.operators import measures, overlay, relate, validity

SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"


def table(spark, rows, **kinds):
    names = ", ".join(f"{k} {v}" for k, v in kinds.items())
    df = spark.createDataFrame(rows, names)
    for k, v in kinds.items():
        if v == "string":
            df = df.withColumn(k, g.st_geomfromtext(F.col(k)))
    return df


def pairs(spark, texts):
    return table(spark, [(i, a, b) for i, (a, b, *_) in enumerate(texts)], pair="int", a="string", b="string")


TEXTS = [
    "POINT (1 2)", "POINT EMPTY", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.25 0.125, 0.5 0.125, 0.5 0.25, 0.25 0.125))", "MULTIPOINT ((1 1), (2 2))",
    "MULTIPOLYGON EMPTY", "GEOMETRYCOLLECTION (POINT EMPTY, GEOMETRYCOLLECTION (POINT (1e-09 3), LINESTRING EMPTY))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "GEOMETRYCOLLECTION EMPTY",
]


@pytest.mark.parametrize("text", TEXTS)
def test_formats_round_trip(text):
    geom = g.read_wkt(text)
    assert g.to_wkt(geom) == text
    assert g.read_wkb(g.to_wkb(geom)) == geom
    assert g.read_json(g.to_json(geom)) == geom


@pytest.mark.parametrize("text", ["SRID=4326;POINT Z (1 2 3)", "point(1 2)", "POINT M (1 2 3)"])
def test_wkt_variants(text):
    assert g.to_wkt(g.read_wkt(text)) == "POINT (1 2)"


@pytest.mark.parametrize("text", ["POINT (1)", "CIRCLE (1 2)", "POINT (1 2", "POINT (1 2) x", "LINESTRING (1 2, )"])
def test_bad_text(text):
    with pytest.raises(g.GeometryFormatError):
        g.read_wkt(text)


@given(st.floats(allow_nan=False))
def test_doubles_read_back(x):
    assert float(g.format_double(x)) == x


@given(st.fractions(min_value=0))
@settings(max_examples=50)
def test_root_bounds(q):
    low, high = sqrt_bounds(q)
    assert low * low <= q <= high * high


def test_permissive_reader(spark):
    df = spark.createDataFrame([("POINT (1 2)",), ("nonsense",), (None,)], "t string").select(g.st_parse_wkt("t").alias("p"))
    rows = [r.p for r in df.collect()]
    assert rows[0].geom is not None and rows[1].error and rows[1].geom is None and rows[2].geom is None


def test_accessors(spark):
    texts = [(SQUARE, 2, 2, False, 5), ("POINT EMPTY", 0, -1, True, 0), ("LINESTRING (1 1, 1 1)", 1, 0, False, 2), ("GEOMETRYCOLLECTION (POINT (0 0), POLYGON EMPTY)", 2, 0, False, 1)]
    df = table(spark, [(i, t[0]) for i, t in enumerate(texts)], id="int", geom="string")
    c = F.col("geom")
    rows = df.select("id", g.st_dim(c).alias("d"), g.st_realdim(c).alias("r"), g.st_isempty(c).alias("e"), g.st_numcoords(c).alias("n")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [t[1:] for t in texts]


RELATE = [
    ("POLYGON ((-0.6 3, 2 -1, -1.7 1.9, -0.6 3))", "POLYGON ((-1.6999999999999997 1.9000000000000004, -1 2, -2.6 1, -1.6999999999999997 1.9000000000000004))", "212101212"),
    ("POINT (0.1 0.3)", "LINESTRING (0 0, 0.3 0.9)", "FF0FFF102"),
    ("LINESTRING (0 0, 1 0, 1 1, 0 0)", "POINT (0 0)", "0F1FFFFF2"),
    (SQUARE, "LINESTRING (-1 1, 3 1)", "1F20F1102"),
    ("POINT EMPTY", "POLYGON EMPTY", "FFFFFFFF2"),
    ("MULTIPOINT (0 0, 1 1, 5 5)", SQUARE, "000FFF212"),
    (SQUARE, "POLYGON ((2 0, 4 0, 4 2, 2 2, 2 0))", "FF2F11212"),
    ("GEOMETRYCOLLECTION (POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0)), POLYGON ((2 0, 4 0, 4 2, 2 2, 2 0)))", "POINT (2 1)", "0F2FF1FF2"),
    ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))", "POLYGON ((3 3, 6 3, 6 6, 3 6, 3 3))", "FF2F112F2"),
    ("GEOMETRYCOLLECTION (POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0)), POINT (10 10))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "212FF1FF2"),
    ("LINESTRING (0 0, 1 1)", "MULTILINESTRING ((1 1, 2 2), (1 1, 3 0))", "FF10F0102"),
]


@pytest.mark.parametrize("lane", [None, "wide"])
def test_relate(spark, lane):
    rows = {r.pair: r.matrix for r in relate.relate(pairs(spark, RELATE), lane).collect()}
    assert [rows[i] for i in range(len(RELATE))] == [m for _, _, m in RELATE]


def test_swapped_operands_transpose(spark):
    swapped = pairs(spark, [(b, a) for a, b, _ in RELATE])
    rows = {r.pair: r.t for r in relate.relate(swapped).select("pair", relate.transpose(F.col("matrix")).alias("t")).collect()}
    assert [rows[i] for i in range(len(RELATE))] == [m for _, _, m in RELATE]


def _cells(a, b):
    """Matrix of two boxes by brute force over the cells of their grid."""
    out = {}
    xs, ys = (sorted({*a[i], *b[i]}) for i in (0, 1))
    at = lambda v: [(v[0] - 1, 1)] + [p for i, x in enumerate(v) for p in ([(x, 0)] + ([((x + v[i + 1]) / 2, 1)] if i + 1 < len(v) else [(x + 1, 1)]))]
    where = lambda box, x, y: "E" if not (box[0][0] <= x <= box[0][1] and box[1][0] <= y <= box[1][1]) else "I" if box[0][0] < x < box[0][1] and box[1][0] < y < box[1][1] else "B"
    for x, dx in at(xs):
        for y, dy in at(ys):
            k = where(a, x, y) + where(b, x, y)
            out[k] = max(out.get(k, -1), dx + dy)
    return "".join(str(out[p + q]) if p + q in out else "F" for p in "IBE" for q in "IBE")


def test_random_boxes_against_cells(spark):
    rng = random.Random(3)
    box = lambda: tuple(tuple(sorted(rng.sample(range(5), 2))) for _ in "xy")
    text = lambda b: f"POLYGON (({b[0][0]} {b[1][0]}, {b[0][1]} {b[1][0]}, {b[0][1]} {b[1][1]}, {b[0][0]} {b[1][1]}, {b[0][0]} {b[1][0]}))"
    some = [(box(), box()) for _ in range(120)]
    rows = {r.pair: r.matrix for r in relate.relate(pairs(spark, [(text(a), text(b)) for a, b in some])).collect()}
    assert [rows[i] for i in range(len(some))] == [_cells(a, b) for a, b in some]


def test_overlay_area_and_text(spark):
    df = pairs(spark, [(SQUARE, "POLYGON ((1 -1, 3 0.1, 1 3, 1 -1))"), (SQUARE, "LINESTRING (-1 1, 3 1)")])
    areas = {(r.pair, r.op): r.area for r in overlay.overlay(df).collect()}
    assert areas[0, "intersection"] == "29063881665648697606023744899294167/15057660889751000093915401739567104"
    assert Fraction(areas[0, "union"]) + Fraction(areas[0, "intersection"]) == 4 + Fraction(areas[0, "symdifference"]) - (4 - 2 * Fraction(areas[0, "intersection"]))
    assert areas[1, "union"] == "4"
    text = {r.pair: r.wkt for r in overlay.overlay_geometry(df, "union").collect()}
    assert text[1] == "GEOMETRYCOLLECTION (POLYGON ((0 0, 2 0, 2 1, 2 2, 0 2, 0 1, 0 0)), LINESTRING (-1 1, 0 1), LINESTRING (2 1, 3 1))"


def test_typed_empties(spark):
    df = pairs(spark, [("POINT (0 0)", SQUARE)])
    assert overlay.overlay_geometry(df, "difference").first().wkt == "POINT EMPTY"


VALID = [
    (SQUARE, []),
    ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", ["self_intersection"]),
    ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 4, 3 3, 3 6, 0 4))", []),
    ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (10 10, 11 10, 11 11, 10 10))", ["hole_outside_shell"]),
    ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1), (2 2, 3 2, 3 3, 2 2))", ["nested_holes"]),
    ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0)), ((1 1, 2 1, 2 2, 1 1)))", ["nested_shells"]),
    ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1)), ((2 2, 3 2, 3 3, 2 2)))", []),
    ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 4, 4 4, 4 5, 0 4), (4 4, 9 4, 8 5, 4 4))", ["disconnected_interior"]),
    ("POLYGON ((0 0, 2 0, 1 1, 2 2, 0 2, 1 1, 0 0))", ["ring_self_intersection"]),
    ("LINESTRING (1 1, 1 1)", ["too_few_points"]),
    ("POLYGON ((0 0, 1 0, 1 1, 0 1))", ["ring_not_closed"]),
    ("POINT (nan 1)", ["invalid_coordinate"]),
]


def test_validity(spark):
    rows = {r.id: r.reasons for r in validity.validate(table(spark, [(i, t) for i, (t, _) in enumerate(VALID)], id="int", geom="string")).collect()}
    assert [rows[i] for i in range(len(VALID))] == [r for _, r in VALID]


def test_measures(spark):
    df = table(spark, [(0, "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"), (1, "LINESTRING (0 0, 3 4, 3 5.5)"), (2, "MULTIPOINT (0 0, 1 0, 5 9)")], id="int", geom="string")
    assert {r.id: r.area for r in measures.area(df).collect()} == {0: "72", 1: "0", 2: "0"}
    assert {r.id: r.length.rounded for r in measures.length(df).collect()}[1] == 6.5
    assert {r.id: (r.x, r.y) for r in measures.centroid(df).collect()} == {0: ("9/2", "9/2"), 1: (None, None), 2: ("2", "3")}
    d = pairs(spark, [(SQUARE, "POINT (5 6)"), ("LINESTRING (0 0, 1 3)", "LINESTRING (4 0, 1 1)"), ("POINT EMPTY", SQUARE), ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)")])
    assert {r.pair: r.distance2 for r in measures.distance2(d).collect()} == {0: "25", 1: "2/5", 2: None, 3: "0"}
    holed = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"
    within = pairs(spark, [("POINT (0.5 1)", SQUARE), (holed, "POINT (5 4.5)"), (holed, "MULTIPOINT (20 20, 8 8.5)"), ("LINESTRING (1 1, 1.5 1)", SQUARE)])
    got = {r.pair: (r.distance2, r.ax, r.ay, r.bx, r.by) for r in measures.distance2(within).collect()}
    assert got == {0: ("0", "1/2", "1", "1/2", "1"), 1: ("1", "6", "9/2", "5", "9/2"), 2: ("0", "8", "17/2", "8", "17/2"), 3: ("0", "1", "1", "1", "1")}


def test_nearest_double():
    assert nearest_double(Fraction(1, 3)) == 1 / 3
    assert nearest_double(Fraction(10) ** 400) == float("inf")


def test_kernels_against_fractions():
    """Crossings and sides on whole columns agree with rational arithmetic, to the end of the lane's range."""
    rng = np.random.default_rng(0)
    for high in (4, 60, (1 << kernels.BITS) - 1):
        c = rng.integers(-high, high + 1, (8, 600))
        c = c[:, ((c[0] != c[2]) | (c[1] != c[3])) & ((c[4] != c[6]) | (c[5] != c[7]))]
        found = kernels.meetings(*map(pa.array, c)).to_pylist()
        for row, points in zip(c.T.tolist(), found):
            assert sorted((p["X"], p["Y"], p["W"]) for p in points) == sorted(kernels._meet(*row))
        met = [(row, p) for row, points in zip(c.T.tolist(), found) for p in points]
        u, v = [p for _, p in met], [p for _, p in met[1:] + met[:1]]
        level = rng.integers(0, 2, len(met)).astype(bool)
        columns = [np.array([p[k] for p in w], np.int64) for w in (u, v) for k in "XYW"] + [level] + [np.array([r[i] for r, _ in met], np.int64) for i in range(4)]
        got = np.stack(kernels.beside(*columns), axis=1)
        for k, (p, q) in enumerate(zip(u, v)):
            x, y = (Fraction(p[a], p["W"]) / 2 + Fraction(q[a], q["W"]) / 2 for a in "XY")
            ax, ay, bx, by = met[k][0][:4]
            o = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            right = o > 0 if by > ay else o < 0
            above, reach = (ay > y) != (by > y), (ay >= y) != (by >= y)
            on = o == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
            assert got[k].tolist() == [above and right, reach and right if level[k] else above and (right or o == 0), on]


def test_narrow_lane_refuses_what_it_cannot_hold(spark):
    for text in ("POINT (0.5 1)", "POINT (2000000 1)"):
        with pytest.raises(Exception, match="narrow lane"):
            relate.relate(pairs(spark, [(text, SQUARE)]), "narrow").collect()


def test_writers_take_rings_of_unlike_lengths(spark):
    """Polygons with holes, parts of unlike lengths and empties through text, JSON and binary and back, in one expression."""
    texts = [
        "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 3 1, 2 3, 1 1))", "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)), ((20 0, 29 0, 29 9, 20 9, 20 0), (21 1, 23 1, 22 3, 21 1)))",
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 5.5))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1, 2 0), POLYGON EMPTY)", "POINT EMPTY", "POINT (0.1 -7)", None,
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", g.st_geomfromtext("t").alias("geom"))
    back = rows.select("k", g.st_astext("geom").alias("t"), g.st_astext(g.st_geomfromjson(g.st_asjson("geom"))).alias("j"), g.st_astext(g.st_geomfromwkb(g.st_asbinary("geom"))).alias("b")).collect()
    for r in back:
        assert r.t == texts[r.k] and r.j == texts[r.k] and r.b == texts[r.k]
