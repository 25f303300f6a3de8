"""Minimising failing cases: each round tries all smaller variants of all cases in one job.

A variant leaves out an element, a ring or a vertex. ``fails`` takes pairs (pair, a, b) and returns
(pair) of those that still fail; the smallest failing variant of each case goes into the next round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrazzo.functions.geometry import POINT, POLYGON, st_numcoords
from terrazzo.session import materialize


def _without(a: Column, i: Column) -> Column:
    """Array ``a`` without its i-th member (from 0)."""
    return F.concat(F.slice(a, F.lit(1), i), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))


def _with_elements(g: Column, elements: Column) -> Column:
    return F.struct(g["type"].alias("type"), elements.alias("elements"))


def _ring_without(ring: Column, i: Column, closed: Column) -> Column:
    """A ring stays closed: without its first vertex it starts and ends at the second."""
    open_ = _without(F.slice(ring, F.lit(1), F.size(ring) - 1), i)
    return F.when(closed, F.concat(open_, F.slice(open_, F.lit(1), F.lit(1)))).otherwise(_without(ring, i))


def variants(g: Column) -> Column:
    """Array of the geometries with one element, hole or vertex less."""
    els = g["elements"]
    n = F.size(els)
    index = lambda size: F.filter(F.sequence(F.lit(-1), size - 1), lambda i: i >= 0)
    fewer = F.when(n > 1, F.transform(index(n), lambda i: _with_elements(g, _without(els, i)))).otherwise(F.slice(F.array(g), F.lit(1), F.lit(0)))

    def put(i: Column, rings: Column) -> Column:
        new = F.transform(els, lambda e, j: F.when(j == i, F.struct(e["path"].alias("path"), e["kind"].alias("kind"), rings.alias("rings"))).otherwise(e))
        return _with_elements(g, new)

    holes = F.flatten(F.transform(els, lambda e, i: F.transform(F.filter(index(F.size(e["rings"])), lambda r: (r > 0) & (e["kind"] == POLYGON)), lambda r: put(i, _without(e["rings"], r)))))

    def vertices(e: Column, i: Column) -> Column:
        closed = e["kind"] == POLYGON
        room = lambda ring: F.when(closed, F.size(ring) > 4).otherwise((e["kind"] != POINT) & (F.size(ring) > 2))
        each = lambda ring, r: F.transform(F.filter(index(F.size(ring) - F.when(closed, 1).otherwise(0)), lambda _: room(ring)), lambda k: put(i, F.transform(e["rings"], lambda other, s: F.when(s == r, _ring_without(ring, k, closed)).otherwise(other))))
        return F.flatten(F.transform(e["rings"], each))

    return F.concat(fewer, holes, F.flatten(F.transform(els, vertices)))


def minimize(failing: DataFrame, fails: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pair, a, b) of the cases, as small as single removals make them while they fail."""
    best = materialize(failing.select("pair", "a", "b"), "minimal")
    done = best.where("false")
    while True:
        both = F.concat(F.transform(variants(F.col("a")), lambda v: F.struct(v.alias("a"), F.col("b").alias("b"))), F.transform(variants(F.col("b")), lambda v: F.struct(F.col("a").alias("a"), v.alias("b"))))
        tried = best.select(F.col("pair").alias("case"), F.posexplode(both).alias("k", "v"))
        tried = materialize(tried.select(F.struct("case", "k").alias("pair"), "v.a", "v.b"), "variants")
        held = tried.join(fails(tried).select("pair").distinct(), "pair")
        size = st_numcoords(F.col("a")) + st_numcoords(F.col("b"))
        first = F.row_number().over(Window.partitionBy("pair.case").orderBy(size, "pair.k"))
        after = materialize(held.withColumn("_n", first).where("_n = 1").select(F.col("pair.case").alias("pair"), "a", "b"), "minimal")
        done = done.unionByName(best.join(after, "pair", "left_anti"))
        if after.isEmpty():
            return done
        best = after
