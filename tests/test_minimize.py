from pyspark.sql import functions as F

from terrazzo.functions import geometry as g
from terrazzo.plans import minimize as m


def test_more_than_thirty_removals(spark):
    """34 points that fail while two of them are there: 32 single removals."""
    rows = spark.createDataFrame([(1, f"MULTIPOINT ({', '.join(f'({i} 0)' for i in range(34))})", "POINT (0 0)")], "pair int, a string, b string")
    cases = rows.select("pair", *(g.st_geomfromtext(c).alias(c) for c in "ab"))
    xs = F.transform(F.flatten(F.flatten(F.transform(F.col("a.elements"), lambda e: e["rings"]))), lambda p: p["x"])
    out = m.minimize(cases, lambda t: t.where(F.array_contains(xs, 7.0) & F.array_contains(xs, 22.0)).select("pair"))
    assert [(r.pair, r.n) for r in out.select("pair", g.st_numcoords(F.col("a")).alias("n")).collect()] == [(1, 2)]
