"""Joins of crowded tables: equal boxes and points are joined once, with their number of rows."""

from collections import Counter
from itertools import product
from random import Random

from pyspark.sql import functions as F

from terrazzo.functions import geometry as g
from terrazzo.operators import locate, measures, model, overlay as ov, spatial_join as sj

_NAMES = ["k", "x1", "x2", "y1", "y2"]


def _meet(a, b):
    return a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]


def _rows(n):
    rng = Random(7)
    rows = []
    for i in range(n):
        x, y = rng.randrange(4), rng.randrange(4)
        rows.append((None if i % 23 == 0 else i - i % 9 % 2, x, x + 1 + rng.randrange(3), y, y + 1 + rng.randrange(3)))  # keys repeat, some lack
    return rows


def _crowd(spark, n):
    """n rows with one of two boxes that touch, by the parity of their key."""
    second = F.col("k") % 2
    return spark.range(n).select(F.col("id").alias("k")).select("k", second.alias("x1"), (second + 1).alias("x2"), second.alias("y1"), F.lit(2).cast("bigint").alias("y2"))


def test_totals_of_repeated_boxes(spark):
    rows = _rows(120)
    want = {}
    for a, b in product(rows, rows):
        if None not in (a[0], b[0]) and a[0] != b[0] and _meet(a, b):
            n, area = want.get(a[0], (0, 0))
            want[a[0]] = n + 1, area + (min(a[2], b[2]) - max(a[1], b[1])) * (min(a[4], b[4]) - max(a[3], b[3]))
    got = sj.box_join_totals(spark.createDataFrame(rows, _NAMES), 2.0).collect()
    assert len(got) == len(want) and {r.k: (r.n, r.area) for r in got} == want


def test_totals_of_a_crowd(spark):
    n = 60_000
    got = sj.box_join_totals(_crowd(spark, n), 16.0).groupBy("n").count().collect()
    assert [(r.n, r["count"]) for r in got] == [(n - 1, n)]


def test_matrices_of_repeated_boxes(spark, monkeypatch):
    monkeypatch.setattr(sj, "KEYS", 2)
    rows = _rows(120)
    df = spark.createDataFrame(rows, _NAMES)
    right = df.select(*(F.col(c).alias(f"{c}_r") for c in _NAMES))
    want = Counter(r.m for r in df.crossJoin(right).where("k < k_r AND x1 <= x2_r AND x1_r <= x2 AND y1 <= y2_r AND y1_r <= y2").select(sj.box_matrix().alias("m")).collect())
    got = sj.box_join_matrices(df, 2.0).collect()
    assert len(got) == len(want) and {r.matrix: r.n for r in got} == want


def test_matrices_of_a_crowd(spark):
    n = 60_000
    got = sj.box_join_matrices(_crowd(spark, n).where("x1 = 0"), 16.0).collect()
    assert [(r.matrix, r.n) for r in got] == [("2FFF1FFF2", n // 2 * (n // 2 - 1) // 2)]
    assert sum(r.n for r in sj.box_join_matrices(_crowd(spark, n), 16.0).collect()) == n * (n - 1) // 2


def test_counts_of_a_crowd(spark):
    n = 30_000
    points = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).alias("x"), F.lit(1).cast("bigint").alias("y"))
    got = sj.count_in_boxes(points, _crowd(spark, n), 16.0).groupBy(F.col("k") % 3, "loc", "n").count().collect()
    # x = 0 and x = 1 are sides of the one box, (1, 1) and (2, 1) corners of the other
    assert sorted(tuple(r) for r in got) == [(0, "B", n // 2, n // 3), (1, "B", n, n // 3), (2, "B", n // 2, n // 3)]


def test_nearest_of_shared_places(spark):
    rng = Random(3)
    rows = [(None if i % 31 == 0 else i - i % 7 % 2, rng.randrange(60) // 7 * 9, rng.randrange(40) // 5 * 9) for i in range(90)] + [(500, 4000, 4000)]
    want = {}
    for i, x, y in rows:
        near = [((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in rows if None not in (i, j) and i != j]
        if near:
            want[i] = min(min(near), want.get(i, min(near)))
    got = measures.nearest_other(spark.createDataFrame(rows, ["id", "x", "y"]), 12.0).collect()
    assert len(got) == len(want) and {r.left_id: (r.distance2, r.right_id) for r in got} == want


def test_nearest_of_a_crowd(spark):
    n = 60_000
    points = spark.range(n).select("id", (F.col("id") % 2).alias("x"), F.lit(0).cast("bigint").alias("y"))
    got = measures.nearest_other(points, 12.0).groupBy("right_id", "distance2").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, n // 2 - 1), (1, 0, n // 2 - 1), (2, 0, 1), (3, 0, 1)]


def test_nearest_of_nothing(spark):
    assert measures.nearest_other(spark.createDataFrame([], "id bigint, x bigint, y bigint"), 12.0).collect() == []


def test_overlay_text_is_built_in_many_tasks(spark):
    c = F.col("k").cast("double")
    boxes = spark.range(40).select(F.col("id").alias("k")).select(F.col("k").alias("pair"), g.box(c, c, c + 2, c + 2).alias("a"), g.box(c + 1, c + 1, c + 3, c + 3).alias("b"))
    out = ov.overlay_geometry(boxes, "intersection", areal=True, lane="narrow").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in out}) > 1
    assert {r.pair: r.wkt for r in out} == {k: f"POLYGON (({k + 1} {k + 1}, {k + 2} {k + 1}, {k + 2} {k + 2}, {k + 1} {k + 2}, {k + 1} {k + 1}))" for k in range(40)}


def test_equal_pairs_are_computed_once(spark):
    c = (F.col("k") % 3).cast("double")
    pairs = spark.range(90).select(F.col("id").alias("k")).select(F.col("k").alias("pair"), g.box(c, c, c + 2, c + 2).alias("a"), F.when(F.col("k") % 5 > 0, g.box(c + 1, c, c + 3, c + 2)).alias("b"))
    seen = []

    def job(some):
        seen.append(some.count())
        return some.select("pair", F.col("a.elements")[0]["rings"][0][0]["x"].alias("x"), F.isnull("b").alias("alone"))

    got = model.once(pairs, job).collect()
    assert seen == [6]
    assert sorted((r.pair, r.x, r.alone) for r in got) == [(k, float(k % 3), k % 5 == 0) for k in range(90)]


def test_measures_are_not_broadcast(spark, tmp_path):
    c = F.col("id").cast("double")
    spark.range(500).write.parquet(str(tmp_path / "ids"))  # small files
    geoms = spark.read.parquet(str(tmp_path / "ids")).select("id", g.box(c, c, c + 2, c + 1).alias("geom"))
    for out in (measures.area(geoms), measures.case_measures(geoms)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.area for r in measures.area(geoms).collect()} == {"2"}


def test_located_points_are_not_broadcast(spark):
    geoms = spark.range(4).select(F.col("id").alias("key"), g.box(*(F.lit(v).cast("double") for v in (0, 0, 2, 2))).alias("geom"))
    points = spark.range(40).select((F.col("id") % 4).alias("key"), "id", (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"))
    out = locate.locate(points, geoms)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id % 3, r.loc) for r in out.collect()} == {(0, "B"), (1, "I"), (2, "B")}
