from pyspark.sql import functions as F

from terrazzo.functions import geometry as g
from terrazzo.plans import sampling, scoring
from terrazzo.sources import cases, export


def _tables(spark):
    c = spark.createDataFrame([("c1", "f"), ("c2", "f"), ("c3", "g"), ("c4", "g")], "id string, family string")
    e = spark.createDataFrame(
        [("c1", "ok", "212101212", {"touches": "false", "equals": "true"}, [], "true", "true"), ("c2", "ok", "FF2FF1212", {"touches": "false", "equals": "false"}, ["equals"], "true", "false"), ("c3", "engine_skipped", None, {}, [], None, None)],
        "id string, status string, relate string, predicates map<string,string>, conventions array<string>, valid_a string, valid_b string",
    )
    r = spark.createDataFrame(
        [
            ("c1", "x@1", "212111212", {"touches": "true", "equals": "true"}, "true", "true", {}), ("c2", "x@1", None, {"touches": "false", "equals": "true"}, "true", None, {"relate": "crash", "valid_b": "crash"}),
            ("c3", "x@1", "unsupported", {}, None, None, {}), ("c4", "x@1", "FF2FF1212", {}, "true", "true", {}),
        ],
        "id string, lib string, relate string, predicates map<string,string>, valid_a string, valid_b string, errors map<string,string>",
    )
    return c, e, r


def test_scores(spark):
    s = {(r.id, r.capability): r for r in scoring.score(*_tables(spark)).collect()}
    assert s["c1", "relate"].verdict == "wrong" and s["c1", "relate"].fields == ["relate.BB"]
    assert s["c1", "predicates"].verdict == "wrong" and s["c1", "predicates"].derived and s["c1", "predicates"].fields == ["predicates.touches"]
    assert s["c2", "relate"].verdict == "error" and s["c2", "predicates"].verdict == "convention" and s["c2", "validity"].verdict == "error"
    assert s["c3", "relate"].verdict == "engine_skipped"
    assert ("c4", "relate") not in s


def test_overlay_tiers(spark):
    cols = "id int, error string, output_valid boolean, same_components boolean, hausdorff double, symdiff_area double, delta_rounding double, delta double, perimeters double, n_vertices int"
    rows = [(0, None, True, True, 0.0, 0.0, 1e-16, None, 4.0, 5), (1, None, True, True, 1e-17, 1e-17, 1e-16, None, 4.0, 5), (2, None, True, True, 1e-9, 1e-9, 1e-16, 1e-8, 4.0, 5),
            (3, None, True, True, 1e-9, 1e-9, 1e-16, None, 4.0, 5), (4, None, False, True, 0.0, 0.0, 1e-16, None, 4.0, 5), (5, "x", True, True, 0.0, 0.0, 1e-16, None, 4.0, 5)]
    got = [r.tier for r in scoring.grade_overlay(spark.createDataFrame(rows, cols)).orderBy("id").collect()]
    assert got == ["exact", "rounding", "budget", "gross", "topological", "exception"]


def test_triage(spark):
    found = spark.createDataFrame([("k1", "a", "f", ["relate"]), ("k2", "b", "g", ["echo"])], "cluster string, lib string, family string, fields array<string>")
    registry = spark.createDataFrame([("e1", "reported", ["a"], [], ["relate"]), ("e2", "fixed", [], ["f"], [])], "entry string, status string, libraries array<string>, families array<string>, fields array<string>")
    assert {r.cluster: r.status for r in scoring.triage(found, registry).collect()} == {"k1": "mixed", "k2": "unreviewed"}


def test_largest_remainders(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, n bigint")
    q = {r.stratum: r.quota for r in sampling.quotas(sizes, 7).collect()}
    assert q == {"a": 4, "b": 2, "c": 1}  # 3.5, 2.1, 1.4: the half gets the seventh


def test_case_files(spark, tmp_path):
    text = spark.createDataFrame([("p1", "f", "POINT (1 2)", "LINESTRING (0 0, 0.1 0.3)")], "pair string, family string, a string, b string")
    c = text.withColumn("a", g.st_geomfromtext(F.col("a"))).withColumn("b", g.st_geomfromtext(F.col("b")))
    cases.write_cases(c, str(tmp_path / "cases"))
    back = cases.read_cases(spark, str(tmp_path / "cases"))
    assert back.select("pair", g.st_astext("b").alias("b")).first() == ("p1", "LINESTRING (0 0, 0.1 0.3)")
    assert cases.digests(c).first().sha256 == cases.digests(back).first().sha256
    found = cases.file_manifest(spark, str(tmp_path / "cases"))
    listed = found.where("path NOT LIKE 'x%'")
    assert cases.manifest_problems(found, listed).count() == 0


def test_exports(spark):
    text = spark.createDataFrame([("p<1", "POINT (1 2)", "POINT (3 4.5)", "FF0FFF0F2")], "pair string, a string, b string, matrix string")
    c = text.withColumn("a", g.st_geomfromtext(F.col("a"))).withColumn("b", g.st_geomfromtext(F.col("b")))
    assert "p&lt;1" in export.jts_xml(c).first().value and 'arg3="FF0FFF0F2"' in export.jts_xml(c).first().value
    assert "POINT (1.0 2.0)" in export.rust_tests(c).first().value
    assert export.integer_polygons(c).first().skipped
