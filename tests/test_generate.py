import pytest
from pyspark.sql import functions as F

from terrazzo.functions import geometry as g
from terrazzo.functions.register import register
from terrazzo.operators import relate, validity
from terrazzo.plans.minimize import minimize
from terrazzo.sources import cases, generate
from terrazzo.streaming.cases import relate_stream, stream_cases


def test_families_are_deterministic_and_valid(spark):
    some = generate.corpus(spark, 4)
    rows = some.select("pair", "family", g.st_astext("a").alias("a"), g.st_astext("b").alias("b")).collect()
    again = {r.pair: (r.a, r.b) for r in generate.corpus(spark, 4).repartition(7).select("pair", g.st_astext("a").alias("a"), g.st_astext("b").alias("b")).collect()}
    assert len({r.family for r in rows}) == 17
    assert all(again.get(r.pair, (r.a, r.b)) == (r.a, r.b) for r in rows)
    sound = some.where("family NOT LIKE 'invalid%' AND family <> 'scaled'")
    bad = validity.validate(sound.select(F.col("pair").alias("id"), F.col("a").alias("geom"))).where("NOT valid").collect()
    assert bad == []


@pytest.mark.parametrize("family", ["near-collinear", "line-line", "gc"])
def test_lanes_and_swaps_agree(spark, family):
    p = generate.generate(spark, family, 12).select("pair", "a", "b").persist()
    m = {r.pair: r.matrix for r in relate.relate(p, "wide").collect()}
    back = relate.relate(p.select("pair", F.col("b").alias("a"), F.col("a").alias("b")), None)
    assert {r.pair: r.t for r in back.select("pair", relate.transpose(F.col("matrix")).alias("t")).collect()} == m
    problems = relate.predicates(p).select(relate.matrix_problems(F.col("matrix"), F.col("dim_a"), F.col("dim_b")).alias("p")).where("size(p) > 0")
    assert problems.count() == 0


def test_minimize(spark):
    a = "MULTIPOLYGON (((0 0, 4 0, 5 2, 4 4, 0 4, 0 0)), ((10 10, 12 10, 12 12, 10 12, 10 10)))"
    df = spark.createDataFrame([("x", a, "LINESTRING (-1 1, 2 1, 3 3, 9 9)")], "pair string, a string, b string")
    df = df.withColumn("a", g.st_geomfromtext(F.col("a"))).withColumn("b", g.st_geomfromtext(F.col("b")))
    crosses = lambda pairs: relate.predicates(pairs).where("crosses")
    out = minimize(df, crosses).select(g.st_numcoords(F.col("a")).alias("a"), g.st_numcoords(F.col("b")).alias("b")).collect()
    assert len(out) == 1 and out[0].a <= 4 and out[0].b == 2


def test_stream(spark, tmp_path):
    p = generate.generate(spark, "int-grid", 6)
    cases.write_cases(p, str(tmp_path / "in"))
    relate_stream(stream_cases(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {r.pair: r.matrix for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.pair: r.matrix for r in relate.relate(p.select("pair", "a", "b")).collect()}


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT st_astext(st_parse_wkt('POINT (1.50 2)').geom) AS t, exact_rational(0.5) AS q").first() == ("POINT (1.5 2)", "1/2")
