"""One form for all ways of writing a geometry, as columns.

Shells run counter-clockwise and holes clockwise, each from its least vertex (of several equal ones, the one from which the
ring reads least); holes are in order; lines run the way that reads least; elements are in order of kind and coordinates; minus zero is
zero. Nested collections become one level. Only the turn of a ring, which needs exact sums, leaves the JVM.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from terrazzo.functions.geometry import LINE, POLYGON


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def ring_turns(xs: pd.Series, ys: pd.Series, sizes: pd.Series, counts: pd.Series) -> pd.Series:
    """The sign of each ring's area, by element: 1 counter-clockwise, 0 flat or not finite. ``sizes`` are the points of each ring, ``counts`` the rings of each element."""

    def turn(x, y) -> int:
        if not all(map(math.isfinite, (*x, *y))):
            return 0
        at = [(Fraction(a), Fraction(b)) for a, b in zip(x, y)]
        total = sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(at, [*at[1:], *at[:1]])), Fraction(0))
        return (total > 0) - (total < 0)

    known = xs.notna().to_numpy()
    join = lambda s: np.concatenate([np.asarray(v, float) for v in s[known]]) if known.any() else np.zeros(0)
    x, y, size = join(xs), join(ys), join(sizes).astype(np.int64)
    ends = np.cumsum(size)
    # doubles first: only rings whose sum is within its error bound are added up exactly
    after = np.arange(1, len(x) + 1)
    full = size > 0
    after[ends[full] - 1] = (ends - size)[full]
    turns = np.zeros(len(size), np.int64)
    unsure = full.copy()
    if full.any():
        with np.errstate(invalid="ignore", over="ignore"):
            a, b = x * y[after], x[after] * y
            total, most = (np.add.reduceat(v, (ends - size)[full]) for v in (a - b, np.abs(a) + np.abs(b)))
            sure = (np.abs(total) > most * size[full] * 2.0**-50) & (most > 1e-200) & (most < 1e300)
        turns[full] = np.where(sure, np.sign(np.where(sure, total, 0)), 0)
        unsure[full] = ~sure
    for k in np.flatnonzero(unsure):
        turns[k] = turn(x[ends[k] - size[k] : ends[k]], y[ends[k] - size[k] : ends[k]])
    every = iter(turns.tolist())
    return pd.Series([[list(itertools.islice(every, int(n))) for n in count] if own else None for own, count in zip(known, counts)], dtype=object)


def _plain(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + 0.0).alias("x"), (p["y"] + 0.0).alias("y")))


def _from_least(body: Column) -> Column:
    """The rotation of an open ring that reads least."""
    low = F.array_min(body)
    starts = F.filter(F.sequence(F.lit(1), F.size(body)), lambda i: F.element_at(body, i) == low)
    return F.array_min(F.transform(starts, lambda i: F.concat(F.slice(body, i, F.size(body) - i + 1), F.slice(body, F.lit(1), i - 1))))


def canonical_ring(ring: Column, turn: Column, ccw: bool) -> Column:
    """A closed ring whose area has the sign ``turn``, in the wanted direction from its least vertex; a flat one the way that reads least."""
    body = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    ahead, back = _from_least(body), _from_least(F.reverse(body))
    own = F.when(turn == 0, F.least(ahead, back)).when(turn == (1 if ccw else -1), ahead).otherwise(back)
    return F.when(F.size(ring) < 2, ring).otherwise(F.concat(own, F.slice(own, F.lit(1), F.lit(1))))


def canonical_line(line: Column) -> Column:
    return F.least(line, F.reverse(line))


def canonicalize(g: Column) -> Column:
    """The canonical form of a geometry column."""
    every = F.flatten(F.transform(g["elements"], lambda e: e["rings"]))
    of = lambda c: F.transform(F.flatten(every), lambda p: p[c])
    turns = ring_turns(of("x"), of("y"), F.transform(every, F.size), F.transform(g["elements"], lambda e: F.size(e["rings"])))

    def rings(e: Column, t: Column) -> Column:
        plain = F.transform(e["rings"], _plain)
        shell = F.transform(F.slice(plain, 1, 1), lambda r: canonical_ring(r, F.get(t, F.lit(0)), True))
        rest = F.greatest(F.size(plain) - 1, F.lit(0))
        holes = F.array_sort(F.zip_with(F.slice(plain, F.lit(2), rest), F.slice(t, F.lit(2), rest), lambda r, k: canonical_ring(r, k, False)))
        return F.when(e["kind"] == POLYGON, F.concat(shell, holes)).when(e["kind"] == LINE, F.transform(plain, canonical_line)).otherwise(plain)

    parts = F.array_sort(F.zip_with(g["elements"], turns, lambda e, t: F.struct(e["kind"].alias("kind"), rings(e, t).alias("rings"))))
    many = g["type"].startswith("Multi") | (g["type"] == "GeometryCollection")
    at = lambda e, path: F.struct(path.cast("array<int>").alias("path"), e["kind"].alias("kind"), e["rings"].alias("rings"))
    elements = F.when(many, F.transform(parts, lambda e, i: at(e, F.array(i)))).otherwise(F.transform(parts, lambda e: at(e, F.array())))
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), elements.alias("elements")))


def geometry_digest(g: Column) -> Column:
    """SHA-256 of the canonical form: equal for all ways of writing one geometry."""
    return F.sha2(F.to_json(canonicalize(g)).cast("binary"), 256)


def elements_of(g: Column, kind: int) -> Column:
    """The elements of one dimension (0, 1 or 2), empty ones left out: with ``kind`` from 0 to 2 a partition of the geometry."""
    return F.filter(g["elements"], lambda e: (e["kind"] == kind) & (F.size(e["rings"]) > 0))


def same_xy(p: Column, q: Column) -> Column:
    """Whether two coordinates are equal: minus zero equals zero, NaN nothing."""
    return (p["x"] == q["x"]) & (p["y"] == q["y"]) & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
