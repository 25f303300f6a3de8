"""Audits of answers, tiers, stores and measures on small tables."""

import math

import pytest

from pyspark.sql import functions as F

from terrazzo.functions import geometry as g
from terrazzo.operators import measures
from terrazzo.plans import audit
from terrazzo.sources import cases, tiers


def test_locked_changes(spark):
    schema = "id string, version string, sha256 string"
    before = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("c", "1", "z"), ("d", "0", "q")], schema)
    after = spark.createDataFrame([("a", "1", "x"), ("b", "1", "w"), ("e", "1", "v")], schema)
    assert sorted(map(tuple, audit.locked_changes(before, after).collect())) == [("b", "changed"), ("c", "removed")]


def test_failure_kinds(spark):
    rows = [("bad 1.5e3 at -7", "t", "f", 1.0, 1.0), (None, "t", "f", 1.0, 1.0), (None, "t", "t", 1.0, 1.2), (None, "t", "t", 1.0, 1.0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "error string, got string, want string, ga double, wa double")
    kind = audit.failure_kind(*(F.col(c) for c in df.columns), 0.1)
    assert [r.k for r in df.select(kind.alias("k")).collect()] == ["error:bad # at #", "value", "area", None, None]


def test_echo(spark):
    df = spark.createDataFrame([(0.0, -0.0), (0.1, 0.1), (0.1, math.nextafter(0.1, 1)), (math.nan, math.nan), (1.0, None)], "a double, b double")
    point = lambda c: g.linestring(F.array(F.struct(F.col(c).alias("x"), F.lit(1.0).alias("y"))))
    assert [r.s for r in df.select(audit.same_echo(point("a"), point("b")).alias("s")).collect()] == [False, True, False, True, False]


def test_tiers_and_scores(spark, tmp_path):
    for tier in ("core", "full"):
        (tmp_path / f"cases/tier={tier}/family=f").mkdir(parents=True)
        (tmp_path / f"cases/tier={tier}/family=f/a.jsonl").write_text(f'{{"id": "{tier}"}}\n')
    root = str(tmp_path / "cases")
    assert [tuple(r) for r in tiers.read_tier(spark, root, "core").select("value", "family").collect()] == [('{"id": "core"}', "f")]
    with pytest.raises(ValueError):
        tiers.read_tier(spark, root, "none")
    (tmp_path / "scores/lib").mkdir(parents=True)
    (tmp_path / "scores/lib/core.score.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    out = tiers.read_scores(spark, str(tmp_path / "scores"), "id string").collect()
    assert sorted((r.id, r.target, r.tier) for r in out) == [("1", "lib", "core"), ("2", "lib", "core")]
    (tmp_path / "expected.jsonl").write_text('{"id": "1", "relate": "x"}\nno json\n')
    assert [tuple(r) for r in tiers.read_expected(spark, str(tmp_path / "expected.jsonl"), "id string, relate string").collect()] == [("1", "x")]


def test_store(spark, tmp_path):
    path, wanted = str(tmp_path / "store"), spark.createDataFrame([("a",), ("b",), ("b",)], "sha256 string")
    hits, misses = tiers.stored(spark, path, wanted, "1")
    assert hits.isEmpty() and sorted(r.sha256 for r in misses.collect()) == ["a", "b"]
    tiers.store(spark.createDataFrame([("a", "x")], "sha256 string, answer string"), path, "1")
    hits, misses = tiers.stored(spark, path, wanted, "1")
    assert [tuple(r) for r in hits.collect()] == [("a", "x")] and [r.sha256 for r in misses.collect()] == ["b"]
    assert tiers.stored(spark, path, wanted, "2")[0].isEmpty()


def test_case_measures(spark):
    texts = ["LINESTRING (0 0, 4 0, 4 3)", "POLYGON ((0 0, 3 0, 0 3, 0 0))", "MULTIPOINT ((0 0), (1 1))", "LINESTRING EMPTY", "LINESTRING (1 1, 1 1)", "LINESTRING (0 0, 2 0, 2 2)"]
    geoms = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", g.st_geomfromtext(F.col("t")).alias("geom"))
    out = {r.id: r for r in measures.case_measures(geoms).collect()}
    assert len(out) == 6 and out[1].area == "9/2" and tuple(out[1].centroid) == ("1", "1") and out[1].line_centroid is None
    assert (out[0].line_centroid.x.lo, out[0].line_centroid.y.hi) == ("20/7", "9/14") and len(out[0].hull) == 3
    assert out[5].line_centroid.x.lo == "3/2"  # segments of one length share a term
    assert tuple(out[2].centroid) == ("1/2", "1/2") and out[3].line_centroid is None and out[4].line_centroid is None


def test_even_odd(spark):
    """A triangle with a hole that leans, and two copies of a ring, which cancel."""
    ring = lambda k, *p: [(k, *a, *b) for a, b in zip(p, p[1:] + p[:1])]
    rows = ring(1, (0, 0), (12, 0), (0, 12)) + ring(1, (1, 1), (4, 2), (2, 5)) + ring(2, (0, 0), (5, 1), (2, 7)) * 2 + ring(3, (0, 0), (5, 1), (2, 7))
    out = {r.id: r.area2 for r in measures.even_odd_area(spark.createDataFrame(rows, "id int, x1 long, y1 long, x2 long, y2 long")).collect()}
    assert out == {1: 144 - 11, 3: 33}


def test_first_of_each_id(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": "x", "n": 0}\n{"id": "z", "n": 5}\n')
    (tmp_path / "a.jsonl").write_text('{"id": "y", "n": 1}\n{"id": "x", "n": 9}\n{"id": "x", "n": 2}\n')
    wanted = spark.createDataFrame([("x",), ("y",)], "id string")
    out = cases.scan_ids(cases.read_lines(spark, str(tmp_path)), wanted).collect()
    assert sorted(r.value for r in out) == ['{"id": "x", "n": 9}', '{"id": "y", "n": 1}']
