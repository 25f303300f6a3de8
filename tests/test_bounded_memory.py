"""Rows of a batch are not all Python objects at once, and equal or joined rows are not kept."""

from terrazzo.functions import geometry as g
from terrazzo.operators import hausdorff, measures
from terrazzo.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_centroids_stream(spark):
    assert "collect_list" not in plan(queries.line_centroids(spark, SF))
    terms = spark.createDataFrame([(1, "4", "3", "1", 1), (1, "9", "6", "9/2", 3), (2, "0", "1", "1", 1), (None, "2", "1/2", "1", 1)], "id bigint, q string, mx string, my string, n bigint")
    got = {r.id: r.x and (r.x.rounded, r.y.rounded) for r in measures.weighted_means(terms).collect()}
    assert got == {1: (24 / 11, 15.5 / 11), 2: (None, None), None: (0.5, 1.0)}


def test_hulls_by_slices(spark):
    text = plan(queries.line_hulls(spark, SF))
    assert "MapInArrow" in text and "ArrowEvalPython" not in text
    rows = spark.createDataFrame([(i, f"LINESTRING (0 0, {i} 0, {i} {i}, 1 1)") for i in range(2, 200)], "id bigint, t string")
    got = {r.id: [tuple(p) for p in r.hull] for r in measures.convex_hull(rows.select("id", g.st_geomfromtext("t").alias("geom"))).collect()}
    assert got == {i: [(0, 0), (i, 0), (i, i)] for i in range(2, 200)}


def test_equal_boxes_are_written_once(spark):
    out = queries.wkt_round_trip(spark, SF)
    assert plan(out).rindex("Aggregate") > plan(out).rindex("ArrowEvalPython")
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert tuple(out.first()) == (n, n, n, n)


def test_vertices_are_not_sorted_with_every_feature(spark, monkeypatch):
    plans = {}
    write = hausdorff.materialize
    monkeypatch.setattr(hausdorff, "materialize", lambda df, name: plans.setdefault(name, plan(df)) and write(df, name))
    rows = spark.createDataFrame([(1, "MULTIPOINT ((0 0), (5 0))", "MULTIPOINT ((0 1), (9 0), (0 1))")], "pair bigint, a string, b string")
    pairs = rows.select("pair", g.st_geomfromtext("a").alias("a"), g.st_geomfromtext("b").alias("b"))
    assert hausdorff.hausdorff2(pairs).first().lo == "16"
    assert "windowspecdefinition(pair" in plans["hausdorff-vertices"] and plans["hausdorff-vertices"].count("Window [") == 1
