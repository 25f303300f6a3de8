"""Matrices without the places where lines of one side only meet each other."""

import random

from terrazzo.functions import geometry as g
from terrazzo.operators import noding, relate
from pyspark.sql import functions as F


def lines(n, seed, size=6):
    """Pairs of a crossing, touching, partly collinear line with a box, a line or two lines on a small grid."""
    rng = random.Random(seed)
    at = lambda: f"{rng.randrange(size)} {rng.randrange(size)}"
    line = lambda k: "(" + ", ".join(at() for _ in range(k)) + ")"
    rows = []
    for i in range(n):
        x, y = rng.randrange(size - 1), rng.randrange(size - 1)
        u, v = x + rng.randint(1, size - x), y + rng.randint(1, size - y)
        box = f"POLYGON (({x} {y}, {u} {y}, {u} {v}, {x} {v}, {x} {y}))"
        other = box if i % 3 else f"LINESTRING {line(5)}" if i % 2 else f"MULTILINESTRING ({line(3)}, {line(4)})"
        rows.append((i, f"LINESTRING {line(12)}", other))
    return rows


def test_matrices_are_the_same_with_fewer_pieces(spark):
    rows = lines(60, 1)
    pairs = spark.createDataFrame(rows, "pair bigint, a string, b string").select("pair", g.st_geomfromtext("a").alias("a"), g.st_geomfromtext("b").alias("b")).persist()
    whole, less = noding.arrange(pairs, "narrow"), noding.arrange(pairs, "narrow", own_lines=False)
    text = lambda a: {r.pair: r.matrix for r in relate.matrices(a).collect()}
    assert text(less) == text(whole) and len(text(whole)) == 60
    assert less.edges.count() < whole.edges.count() * 0.75
    assert {r.pair: r.matrix for r in relate.relate(pairs, "narrow").select("pair", F.col("matrix")).collect()} == text(whole)
