"""Certificates of overlay results: does a geometry hold exactly the points that the operation asks for?

Both operands and the result are read anew, brought to one grid of integers and cut at all points where any of them meet.
Witness points of every node, sub-segment and face (``witness.placed``) are located in all three. Where they lie in the operands
says what is selected, and that says where they have to lie in the result:

- a face is inside if it is selected, else outside;
- a sub-segment between two selected faces is inside, beside one on the boundary; away from them it is inside, as a
  line, if it is selected itself, else outside;
- a node that only selected faces surround is inside, one that some do is on the boundary; away from them, an odd
  number of selected lines makes it boundary, an even one interior, and without lines it is inside if it is
  selected itself, else outside.

The areal variant has no lines and points. Nothing is taken from the arrangement that built the result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from terrazzo.functions.exact import format_rational, to_rational
from terrazzo.functions.geometry import read_wkt
from terrazzo.operators import model
from terrazzo.operators.overlay import OPERATIONS, operation, overlay_geometry
from terrazzo.operators.witness import LEFT, MIDDLE, NODE, placed
from terrazzo.session import materialize

_PARTS = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType()) for k in ("elem", "kind", "ring", "i")] + [T.StructField(k, T.StringType()) for k in ("x", "y", "x2", "y2")]))


@F.pandas_udf(_PARTS)
def exact_coordinates(text: pd.Series) -> pd.Series:
    """The coordinates of well-known texts with rational ordinates, each with the next one of its ring (null at the end)."""
    out = []
    for t in text:
        rows = []
        for elem, e in enumerate(read_wkt(t, Fraction)["elements"]):
            for ring, points in enumerate(e["rings"]):
                at = [(format_rational(p["x"]), format_rational(p["y"])) for p in points]
                for i, (p, q) in enumerate(zip(at, [*at[1:], (None, None)])):
                    rows.append({"elem": elem, "kind": e["kind"], "ring": ring, "i": i, "x": p[0], "y": p[1], "x2": q[0], "y2": q[1]})
        out.append(rows)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _common(denominators: pd.Series) -> pd.Series:
    return pd.Series([str(math.lcm(*map(int, some))) if len(some) else "1" for some in denominators], dtype=object)


@F.pandas_udf(T.StringType())
def _times(x: pd.Series, unit: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else str(int(Fraction(v) * int(u))) for v, u in zip(x, unit)], dtype=object)


def on_common_grid(coords: DataFrame) -> DataFrame:
    """Coordinates with rational ordinates as integers: those of each pair times their least common denominator."""
    below = lambda c: F.get(F.split(c, "/"), F.lit(1))
    parts = coords.select("pair", F.explode(F.array_compact(F.array(below("x"), below("y")))).alias("d")).distinct()
    units = parts.groupBy("pair").agg(_common(F.collect_set("d")).alias("_unit"))  # of one pair
    rows = coords.join(units, "pair", "left").withColumn("_unit", F.coalesce("_unit", F.lit("1")))
    return rows.withColumns({c: _times(c, "_unit") for c in ("x", "y", "x2", "y2")}).drop("_unit")


def _selected(op: Column, a: Column, b: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for name, holds in OPERATIONS.items():
        out = F.when(op == name, holds(a, b)).otherwise(out)
    return out


def certify(pairs: DataFrame, results: DataFrame, areal: bool = False) -> DataFrame:
    """(pair, op, ok, nodes, edges, faces, mismatches, first) of results (pair, op, exact: well-known text with rational ordinates) of pairs (pair, a, b).

    nodes, edges and faces count the witnesses, ``first`` is the least one that lies elsewhere: kind, u, v, expected, found.
    """
    key = F.struct("pair", "op").alias("pair")
    asked = pairs.join(results.select("pair", "op", "exact"), "pair")
    own = model.coordinates(asked.select(key, "a", "b"))
    own = own.withColumns({c: to_rational(c) for c in ("x", "y", "x2", "y2")})
    made = asked.select(key, F.explode(exact_coordinates("exact")).alias("c")).select("pair", F.lit(2).alias("g"), "c.*")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not for AQE to coalesce
    coords = materialize(on_common_grid(own.unionByName(made).repartition(tasks, "pair")), "certificate-coordinates")
    rows = placed(coords, (0, 1, 2))
    rows = rows.withColumn("sel", _selected(F.col("pair.op"), F.col("loc_0") != "E", F.col("loc_1") != "E"))
    rows = materialize(rows.select("pair", "kind", "u", "v", "sel", F.col("loc_2").alias("found")), "selected")

    side = lambda k: F.bool_or(F.when(F.col("kind") == k, F.col("sel")))
    edges = rows.where(F.col("v").isNotNull()).groupBy("pair", "u", "v").agg(side(MIDDLE).alias("own"), side(LEFT).alias("l"), side("right").alias("r"), F.max(F.when(F.col("kind") == MIDDLE, F.col("found"))).alias("found"))
    line = ~F.col("l") & ~F.col("r") & F.col("own") & F.lit(not areal)
    edges = edges.withColumns({"both": F.col("l") & F.col("r"), "some": F.col("l") | F.col("r"), "line": line})
    ends = edges.select("pair", F.explode(F.array("u", "v")).alias("u"), "both", "some", "line")
    ends = ends.groupBy("pair", "u").agg(F.bool_and("both").alias("both"), F.bool_or("some").alias("some"), F.count_if("line").alias("lines"))
    faces = rows.where(~F.col("kind").isin(NODE, MIDDLE))
    alone = faces.where(F.col("v").isNull()).select("pair", "u", F.col("sel").alias("both"), F.col("sel").alias("some"), F.lit(0).cast("bigint").alias("lines"))
    nodes = rows.where(F.col("kind") == NODE).join(ends.unionByName(alone), ["pair", "u"])

    inside = lambda c: F.when(c, "I").otherwise("E")
    near = F.when(F.col("both"), "I").when(F.col("some"), "B")
    point = F.when(F.col("lines") % 2 == 1, "B").otherwise(inside((F.col("lines") > 0) | (F.col("sel") & F.lit(not areal))))
    checks = faces.select("pair", "kind", "u", "v", "found", inside(F.col("sel")).alias("expected"))
    checks = checks.unionByName(edges.select("pair", F.lit(MIDDLE).alias("kind"), "u", "v", "found", near.otherwise(inside(F.col("line"))).alias("expected")))
    checks = checks.unionByName(nodes.select("pair", "kind", "u", "v", "found", near.otherwise(point).alias("expected")))
    wrong = F.col("found") != F.col("expected")
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    verdict = checks.groupBy("pair").agg(
        of(NODE).alias("nodes"), of(MIDDLE).alias("edges"), (F.count(F.lit(1)) - of(NODE, MIDDLE)).alias("faces"), F.count_if(wrong).alias("mismatches"),
        F.min(F.when(wrong, F.struct("kind", "u", "v", "expected", "found"))).alias("first"),
    )
    out = asked.select(key).join(verdict, "pair", "left").na.fill(0, ["nodes", "edges", "faces", "mismatches"])
    return out.select("pair.pair", "pair.op", (F.col("mismatches") == 0).alias("ok"), "nodes", "edges", "faces", "mismatches", "first")


def overlay_certified(pairs: DataFrame, name: str, areal: bool = False, lane: str | None = None) -> DataFrame:
    """(pair, op, exact, wkt and the certificate) of one operation over pairs (pair, a, b)."""
    name, _ = operation(name)
    made = materialize(overlay_geometry(pairs, name, areal, lane).withColumn("op", F.lit(name)), "overlays")
    return made.join(certify(pairs, made, areal), ["pair", "op"])
