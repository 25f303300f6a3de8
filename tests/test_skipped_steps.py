"""Steps that small geometries do not call for are not taken, and ids that travel are short."""

import pandas as pd

from terrazzo.functions import canonical, geometry as g
from terrazzo.operators import certify, locate, relate, validity, witness
from terrazzo.plans import queries
from tests.test_geometry import RELATE, pairs
from tests.test_witness import shapes


def never(*_):
    raise AssertionError("not called for")


def table(spark, rows, *names):
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n in ('id', 'pair', 'key') else 'string'}" for n in names))
    return df.select(*(g.st_geomfromtext(n).alias(n) if n in ("geom", "a", "b") else n for n in names))


def test_single_rings_meet_no_other(spark, monkeypatch):
    monkeypatch.setattr(validity, "_ring_relations", never)
    monkeypatch.setattr(validity, "_touch_cycles", never)
    rows = [(1, "POLYGON ((0 0, 4 0, 4 4, 0 0))"), (2, "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"), (3, "POLYGON ((0 0, 2 2, 4 4, 0 0))")]
    assert {r.id: r.valid for r in validity.validate(table(spark, rows, "id", "geom"), "narrow").collect()} == {1: True, 2: False, 3: False}


def test_points_in_polygons_meet_no_lines(spark, monkeypatch):
    monkeypatch.setattr(locate, "on_edges", never)
    geoms = table(spark, [(1, "POLYGON ((0 0, 8 0, 0 8, 0 0))")], "key", "geom")
    points = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 4.0, 4.0), (1, 3, 9.0, 9.0)], "key bigint, id bigint, x double, y double")
    assert sorted((r.id, r.loc, r.dim) for r in locate.locate(points, geoms).collect()) == [(1, "I", 2), (2, "B", 2), (3, "E", -1)]


def test_witnesses_are_joined_by_number(spark, monkeypatch):
    ids = []
    located = witness.located
    monkeypatch.setattr(witness, "located", lambda points, *rest: ids.append(points.schema["id"].dataType) or located(points, *rest))
    rows = [(1, "POLYGON ((0 0, 8 0, 0 8, 0 0))", "POLYGON ((1 1, 9 1, 1 9, 1 1))"), (2, "POLYGON ((0 0, 4 0, 0 4, 0 0))", "LINESTRING (1 1, 9 9)")]
    got = {r.pair: r.matrix for r in witness.relate_witness(table(spark, rows, "pair", "a", "b")).collect()}
    assert got == {1: "212101212", 2: "1020F1102"}
    assert [k.fieldNames() for k in ids] == [["n", "kind"]]


def test_turns_by_doubles(monkeypatch):
    """Only rings near flatness are added up exactly."""
    one = lambda v: pd.Series([v])
    turns = lambda x, y: canonical.ring_turns.func(one(x), one(y), one([len(x)]), one([1]))[0]
    assert turns([0.0, 1e-30, 2e-30, 0.0], [0.0, 1e-30, 2e-30, 0.0]) == [[0]]
    monkeypatch.setattr(canonical, "Fraction", never)
    assert turns([0.0, 3.0, 0.0, 0.0], [0.0, 0.0, 3.0, 0.0]) == [[1]] and turns([0.0, 0.0, 3.0, 0.0], [0.0, 3.0, 0.0, 0.0]) == [[-1]]


def test_points_on_lines_meet_no_rays(spark, monkeypatch):
    monkeypatch.setattr(locate, "ray_hits", never)
    geoms = table(spark, [(1, "LINESTRING (0 0, 4 4, 8 0)"), (2, "LINESTRING (1 1, 1 1)")], "key", "geom")
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 6.0, 2.0), (1, 3, 9.0, 9.0), (2, 1, 1.0, 1.0)], "key bigint, id bigint, x double, y double")
    assert sorted((r.key, r.id, r.loc, r.dim) for r in locate.locate(points, geoms).collect()) == [(1, 1, "B", 1), (1, 2, "I", 1), (1, 3, "E", -1), (2, 1, "I", 1)]


def test_only_places_on_lines_are_located(spark, monkeypatch):
    """Of all suppliers' places with all users' lines few are located; every supplier and user has its row all the same."""
    d, sent = "/root/testdata/sf0.001", []
    found = locate.locate
    monkeypatch.setattr(locate, "locate", lambda points, geoms: sent.append(points) or found(points, geoms))
    out = queries.line_points(spark, d)
    users = queries.lines(spark, d).select("k").distinct().selectExpr("k AS key", "k % 10 AS d")
    pairs = users.join(queries.points(spark, d).selectExpr("k AS id", "k % 10 AS d"), "d")
    assert sorted(map(tuple, out.select("key", "id").collect())) == sorted(map(tuple, pairs.select("key", "id").collect()))
    assert sent[0].count() == out.where("loc <> 'E'").count() < out.count() / 4


FRACTIONS = [("POLYGON ((0.1 0.1, 0.7 0.2, 0.3 0.9, 0.1 0.1))", "LINESTRING (0 0.3, 0.9 0.4)"), ("POINT (1e-9 1)", "LINESTRING (0 1, 1e-8 1)"), ("POINT EMPTY", "POINT (1 2)")]


def test_small_pairs_are_placed_whole(spark, monkeypatch):
    """Witnesses and their locations are those of the joins, also where only some pairs are small."""
    rows = shapes(11, 24) + FRACTIONS + [("GEOMETRYCOLLECTION (POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0)), POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0)), POLYGON ((0 4, 8 4, 4 8, 0 4)))", "LINESTRING (2 2, 2 2)")]
    coords = witness.materialize(witness.model.on_grid(witness.model.coordinates(pairs(spark, rows)), witness.LANES["wide"]), "coordinates")
    of = lambda df: sorted(df.collect(), key=str)
    joined = of(witness.placed(coords))
    monkeypatch.setattr(witness, "MANY", 0)
    monkeypatch.setattr(witness, "SMALL", 12)
    assert of(witness.placed(coords)) == joined
    monkeypatch.setattr(witness, "SMALL", 64)
    monkeypatch.setattr(witness, "located", never)
    assert of(witness.placed(coords)) == joined
    some = pairs(spark, [(a, b) for a, b, _ in RELATE])
    got = {r.pair: r.matrix for r in witness.relate_witness(some).collect()}
    assert [got[i] for i in range(len(RELATE))] == [m for _, _, m in RELATE]
    both = pairs(spark, rows)
    assert [r for r in witness.dual_agreement(both, relate.relate(both)).collect() if not r.agree] == []
    out = certify.overlay_certified(both, "union").collect()
    assert len(out) == len(rows) and [(r.pair, r.op, r.first) for r in out if not r.ok] == []


def test_moved_boxes_are_certified_once(spark, monkeypatch):
    rows = [(k, x, x + 3, y, y + 2, x + 1, x + 5, y + dy, y + dy + 2) for k, (x, y, dy) in enumerate([(1, 5, 1), (40, 90, 1), (7, 0, 1), (7, 0, 9)])]
    some = spark.createDataFrame(rows, "pair bigint, " + ", ".join(f"{c}{r} bigint" for r in ("", "_r") for c in ("x1", "x2", "y1", "y2")))
    monkeypatch.setattr(queries, "box_pairs", lambda *_: some)
    seen = []
    certified = certify.overlay_certified
    monkeypatch.setattr(certify, "overlay_certified", lambda p, *rest, **kw: seen.append(p.count()) or certified(p, *rest, **kw))
    out = {r.pair: (r.ok, r.nodes) for r in queries.box_certificates(spark, "").collect()}
    assert seen == [2] and out == {0: (True, 10), 1: (True, 10), 2: (True, 10), 3: (True, 8)}
