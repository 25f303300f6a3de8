"""Spatial joins across tables: a grid turns box overlap into an equi-join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

#: Keys in a row of a class of equal boxes.
KEYS = 4096
#: Parts into which the distinct boxes of a cell are dealt, each joined with the whole cell.
PARTS = 16


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("bigint"), F.floor(high / cell).cast("bigint"))


def box_join(left: DataFrame, right: DataFrame, cell: float, parts: int = 1) -> DataFrame:
    """Rows of both tables whose closed boxes (x1, x2, y1, y2) meet; right columns get the suffix _r.

    Both sides are copied to the cells that their boxes touch and joined by cell. A pair is kept in one of its cells
    only: the one that holds the lower left corner of the common box. ``cell`` should exceed most boxes;
    larger ones cost their number of cells. Crowded cells are split: left rows are dealt to ``parts`` tasks, right ones copied to each.
    """
    r = right.select(*(F.col(c).alias(f"{c}_r") for c in right.columns))

    def spread(df: DataFrame, s: str) -> DataFrame:
        xs, ys = (_cells(F.col(f"{k}1{s}"), F.col(f"{k}2{s}"), cell) for k in "xy")
        return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))

    meet = (F.col("x1") <= F.col("x2_r")) & (F.col("x1_r") <= F.col("x2")) & (F.col("y1") <= F.col("y2_r")) & (F.col("y1_r") <= F.col("y2"))
    owner = lambda k: F.floor(F.greatest(f"{k}1", f"{k}1_r") / cell).cast("bigint") == F.col(f"_c{k}")
    a, b, keys = spread(left, ""), spread(r, "_r"), ["_cx", "_cy"]
    if parts > 1:
        a = a.withColumn("_part", F.pmod(F.xxhash64(*(f"{k}{i}" for k in "xy" for i in (1, 2))), F.lit(parts)))
        b = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        keys.append("_part")
        n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * parts)
        a, b = (rows.repartition(n, *keys) for rows in (a, b))  # a fixed number: few bytes stand for many pairs
        b = b.hint("shuffle_hash")
    rows = a.join(b, keys).where(meet & owner("x") & owner("y"))
    return rows.drop(*keys)


def box_matrix() -> Column:
    """DE-9IM matrix of two boxes (x1 .. y2 and x1_r .. y2_r) in closed form."""
    c = F.col
    open_ = lambda k: (c(f"{k}1") < c(f"{k}2_r")) & (c(f"{k}1_r") < c(f"{k}2"))
    closed = lambda k: (c(f"{k}1") <= c(f"{k}2_r")) & (c(f"{k}1_r") <= c(f"{k}2"))
    inside = lambda a, b, k: (c(f"{k}1{a}") >= c(f"{k}1{b}")) & (c(f"{k}2{a}") <= c(f"{k}2{b}"))
    strictly = lambda a, b, k: (c(f"{k}1{a}") > c(f"{k}1{b}")) & (c(f"{k}2{a}") < c(f"{k}2{b}"))
    shares = lambda k: (c(f"{k}1") == c(f"{k}1_r")) | (c(f"{k}1") == c(f"{k}2_r")) | (c(f"{k}2") == c(f"{k}1_r")) | (c(f"{k}2") == c(f"{k}2_r"))
    both = open_("x") & open_("y")
    ab, ba = (inside(a, b, "x") & inside(a, b, "y") for a, b in (("", "_r"), ("_r", "")))
    deep = (strictly("", "_r", "x") & strictly("", "_r", "y")) | (strictly("_r", "", "x") & strictly("_r", "", "y"))
    flag = lambda cond, t: F.when(cond, t).otherwise("F")
    along = (open_("y") & shares("x")) | (open_("x") & shares("y"))
    bb = F.when(along, "1").when(closed("x") & closed("y") & ~deep, "0").otherwise("F")
    return F.concat(flag(both, "2"), flag(both & ~ab, "1"), flag(~ab, "2"), flag(both & ~ba, "1"), bb, flag(~ab, "1"), flag(~ba, "2"), flag(~ba, "1"), F.lit("2"))


_SIDES = ("x1", "x2", "y1", "y2")


def _weighed(boxes: DataFrame) -> DataFrame:
    """Distinct boxes and their number of rows, dealt anew: few rows may stand for many."""
    return boxes.groupBy(*_SIDES).agg(F.count(F.lit(1)).alias("w"))


def _same_key(boxes: DataFrame) -> DataFrame:
    """Ordered pairs of rows with one key whose boxes meet, each with itself included: distinct boxes of a key, the pair's number of rows in n."""
    rows = boxes.where("k IS NOT NULL").groupBy("k", *_SIDES).agg(F.count(F.lit(1)).alias("w"))
    other = rows.select("k", *(F.col(c).alias(f"{c}_r") for c in (*_SIDES, "w")))
    meet = "x1 <= x2_r AND x1_r <= x2 AND y1 <= y2_r AND y1_r <= y2"
    return rows.join(other, "k").where(meet).withColumn("n", F.col("w") * F.col("w_r")).drop("w", "w_r")


def _common_area() -> Column:
    side = lambda c: F.least(f"{c}2", f"{c}2_r") - F.greatest(f"{c}1", f"{c}1_r")
    return side("x") * side("y")


def box_join_totals(boxes: DataFrame, cell: float) -> DataFrame:
    """(k, n, area): of each box (k, x1, x2, y1, y2) its number of meetings with boxes of other keys and its common area with them.

    Equal boxes are joined once, with their number of rows as a weight; pairs of rows with one key are taken off.
    """
    some = boxes.where("k IS NOT NULL")
    each = _weighed(some)
    found = box_join(each, each, cell, PARTS).groupBy(*_SIDES).agg(F.sum("w_r").alias("n"), F.sum(F.col("w_r") * _common_area()).alias("area"))
    rows = some.groupBy("k", *_SIDES).agg(F.count(F.lit(1)).alias("w")).join(found, list(_SIDES)).select("k", (F.col("w") * F.col("n")).alias("n"), (F.col("w") * F.col("area")).alias("area"))
    own = _same_key(boxes).select("k", (-F.col("n")).alias("n"), (-F.col("n") * _common_area()).alias("area"))
    return rows.unionByName(own).groupBy("k").agg(F.sum("n").alias("n"), F.sum("area").alias("area")).where("n > 0")


@F.pandas_udf(T.LongType())
def _ascents(low: pd.Series, high: pd.Series) -> pd.Series:
    """Of two sorted arrays of keys: the number of pairs of one of the first and a larger one of the second."""
    return pd.Series([int(np.searchsorted(a, b, "left").sum()) for a, b in zip(low, high)], dtype="int64")


def box_join_matrices(boxes: DataFrame, cell: float) -> DataFrame:
    """(matrix, n): pairs of boxes (k, x1, x2, y1, y2) that meet, the one with the smaller key first, by DE-9IM matrix.

    Equal boxes are joined once. A matrix that reads alike from both sides counts rows times rows, less those with one key; where
    one box lies in the other, the sorted keys of both tell how many pairs have the smaller key first.
    """
    some = boxes.where("k IS NOT NULL")
    each = _weighed(some)
    # a matrix depends on the order of the sides alone, and is written once for each order
    signs = [F.signum(F.col(f"{c}{i}") - F.col(f"{c}{j}_r")).cast("int").alias(f"{c}{i}{j}") for c in "xy" for i in (1, 2) for j in (1, 2)]
    names = [f"{c}{i}{j}" for c in "xy" for i in (1, 2) for j in (1, 2)]
    within = F.lit(True)
    covers = F.lit(True)
    for c in "xy":
        within = within & (F.col(f"{c}1") >= F.col(f"{c}1_r")) & (F.col(f"{c}2") <= F.col(f"{c}2_r"))
        covers = covers & (F.col(f"{c}1") <= F.col(f"{c}1_r")) & (F.col(f"{c}2") >= F.col(f"{c}2_r"))
    like = within == covers
    form = lambda rows, n: rows.groupBy(*signs).agg(F.sum(n).alias("n"), *(F.first(f"{c}{s}").alias(f"{c}{s}") for c in _SIDES for s in ("", "_r"))).drop(*names)
    equal = form(box_join(each, each, cell, PARTS).where(like), F.col("w") * F.col("w_r"))
    equal = equal.unionByName(form(_same_key(some).where(like), -F.col("n")))
    equal = equal.groupBy(box_matrix().alias("matrix")).agg((F.sum("n") / 2).cast("bigint").alias("n"))
    run = F.floor((F.row_number().over(Window.partitionBy(*_SIDES).orderBy("k")) - 1) / KEYS)
    runs = some.withColumn("_run", run).groupBy(*_SIDES, "_run").agg(F.sort_array(F.collect_list("k")).alias("ks")).drop("_run")
    nested = form(box_join(runs, runs, cell, PARTS).where(~like), _ascents("ks", "ks_r"))
    nested = nested.groupBy(box_matrix().alias("matrix")).agg(F.sum("n").alias("n"))
    return equal.unionByName(nested).groupBy("matrix").agg(F.sum("n").alias("n")).where("n > 0")


def locate_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) and the boxes that hold them, with ``loc``: I inside, B on the border."""
    p = points.withColumn("x1", F.col("x")).withColumn("x2", F.col("x")).withColumn("y1", F.col("y")).withColumn("y2", F.col("y"))
    border = (F.col("x") == F.col("x1_r")) | (F.col("x") == F.col("x2_r")) | (F.col("y") == F.col("y1_r")) | (F.col("y") == F.col("y2_r"))
    return box_join(p, boxes, cell).withColumn("loc", F.when(border, "B").otherwise("I"))


def count_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(k, loc, n): how many boxes hold each point (k, x, y), inside and on the border. Equal points and equal boxes are located once."""
    at = locate_in_boxes(points.select("x", "y").distinct(), _weighed(boxes), cell).groupBy("x", "y", "loc").agg(F.sum("w_r").alias("n"))
    return points.join(at, ["x", "y"]).groupBy("k", "loc").agg(F.sum("n").alias("n"))


def locate_in_rings(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, id, loc): points (key, id, x, y) against the ring edges (key, x1, y1, x2, y2) of the polygon with their key; E outside."""
    c = F.col
    o = (c("x2") - c("x1")) * (c("y") - c("y1")) - (c("y2") - c("y1")) * (c("x") - c("x1"))
    on = (o == 0) & c("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & c("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    over = ((c("y1") > c("y")) != (c("y2") > c("y"))) & F.when(c("y2") > c("y1"), o > 0).otherwise(o < 0)
    rows = points.join(edges, "key").groupBy("key", "id").agg(F.bool_or(on).alias("on"), (F.sum(over.cast("int")) % 2 == 1).alias("odd"))
    return rows.select("key", "id", F.when(c("on"), "B").when(c("odd"), "I").otherwise("E").alias("loc"))
