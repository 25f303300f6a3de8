"""Exact witness points of every cell that geometries cut the plane into, and what follows from where they lie.

The segments of all sides of a pair are split where they meet. Every node is a witness of dimension 0, the midpoint of
every sub-segment one of dimension 1, and a point just beside it on either side one of dimension 2. All are located in the
original geometries (``locate.located``), never by the labels of an arrangement, and always on the lane of unbounded integers.

How near a point beside a midpoint must be follows from the grid alone: a midpoint (X / W, Y / W) that is not on a
segment between grid points of length L or less is further than 1 / (W L) from it, as its cross product with
the segment is a multiple of 1 / W, and not nearer than 1 / W to a grid point. A shorter step meets nothing else.

Where a table has many pairs, those of up to ``SMALL`` coordinates are cut and located whole, a row each, by ``place``: it does what the
joins do for pairs of any size, whose rows would be some hundred a pair.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from terrazzo.functions.kernels import LANES, WIDE_POINT, _meet
from terrazzo.operators import model, noding
from terrazzo.operators.locate import covered_all_round, located
from terrazzo.operators.model import LINE, POINT, POLYGON
from terrazzo.operators.relate import CELLS
from terrazzo.session import materialize

_POINT = T.StructType([T.StructField(k, T.StringType()) for k in "XYW"])
_THREE = T.StructType([T.StructField(k, _POINT) for k in ("middle", "left", "right")])


def beside_middle(u: tuple[int, int, int], v: tuple[int, int, int], size: int) -> list[tuple[int, int, int]]:
    """The midpoint of u and v, and points beside it that no segment between grid points of ordinates up to ``size`` parts from it."""
    x, y, w = u[0] * v[2] + v[0] * u[2], u[1] * v[2] + v[1] * u[2], 2 * u[2] * v[2]
    a, b = v[0] * u[2] - u[0] * v[2], v[1] * u[2] - u[1] * v[2]
    g = math.gcd(a, b) or 1
    a, b = a // g, b // g
    k = (w * (abs(a) + abs(b)) * 3 * (size + 1)).bit_length() + 1  # a segment is shorter than 3 (size + 1)
    out = [(x, y, w)]
    for s in (1, -1):
        out.append(((x << k) - s * b * w, (y << k) + s * a * w, w << k))
    return [(p // d, q // d, r // d) for p, q, r in out for d in (math.gcd(p, q, r),)]


def _texts(p: tuple[int, int, int]) -> dict[str, str]:
    return {"X": str(p[0]), "Y": str(p[1]), "W": str(p[2])}


@F.pandas_udf(_THREE)
def _beside_middle(u: pd.DataFrame, v: pd.DataFrame, size: pd.Series) -> pd.DataFrame:
    ints = lambda d: list(zip(*(map(int, d[k]) for k in "XYW")))
    rows = [[_texts(p) for p in beside_middle(a, b, int(s))] for a, b, s in zip(ints(u), ints(v), size)]
    return pd.DataFrame({n: pd.DataFrame([r[k] for r in rows], columns=list("XYW")).to_dict("records") for k, n in enumerate(_THREE.names)}, columns=_THREE.names)


@F.pandas_udf(_POINT)
def _beside_node(p: pd.DataFrame, size: pd.Series) -> pd.DataFrame:
    """A point next to an isolated grid point: a horizontal step parts it from no segment that isn't through it."""
    out = []
    for x, y, s in zip(map(int, p["X"]), map(int, p["Y"]), size):
        k = (3 * (int(s) + 1)).bit_length() + 1
        out.append(_texts(((x << k) + 1, y << k, 1 << k)))
    return pd.DataFrame(out, columns=list("XYW"))


#: Kinds of witnesses and their dimensions.
NODE, MIDDLE, LEFT, RIGHT, AROUND = "node", "middle", "left", "right", "around"
DIMENSION = {NODE: 0, MIDDLE: 1, LEFT: 2, RIGHT: 2, AROUND: 2}


def witnesses(coords: DataFrame) -> DataFrame:
    """(pair, id, p) of coordinates of pairs on the wide grid; id is (kind, u, v): u and v the ends of the sub-segment, or u a node and v null."""
    lane = LANES["wide"]
    bound = F.greatest(*(F.length(F.ltrim(F.lit("-"), F.col(c))) for c in ("x", "y")))
    digits = coords.groupBy("pair").agg(F.max(bound).alias("digits")).select("pair", F.concat(F.lit("1"), F.repeat(F.lit("0"), F.col("digits"))).alias("size"))
    segs, points = model.segments(coords), model.isolated_points(coords)
    pieces, _ = noding.split(segs, points, lane)
    pieces = materialize(pieces.select("pair", "u", "v").distinct().join(digits, "pair"), "pieces")
    three = pieces.withColumn("t", _beside_middle("u", "v", "size"))
    beside = F.array(*(F.struct(F.struct(F.lit(kind).alias("kind"), "u", "v").alias("id"), F.col(f"t.{n}").alias("p")) for kind, n in ((MIDDLE, "middle"), (LEFT, "left"), (RIGHT, "right"))))
    out = three.select("pair", F.explode(beside).alias("w")).select("pair", "w.id", "w.p")
    none = F.lit(None).cast(WIDE_POINT)
    ends = pieces.select("pair", F.explode(F.array("u", "v")).alias("u")).distinct()
    alone = points.select("pair", lane.point(F.col("x"), F.col("y")).alias("u")).distinct().join(ends, ["pair", "u"], "left_anti")
    of = lambda rows, kind, p: rows.select("pair", F.struct(F.lit(kind).alias("kind"), F.col("u"), none.alias("v")).alias("id"), p.alias("p"))
    around = of(alone.join(digits, "pair"), AROUND, _beside_node("u", "size"))
    return out.unionByName(of(ends.unionByName(alone), NODE, F.col("u"))).unionByName(around)


#: Coordinates of pairs that ``place`` takes, and pairs that a table has at least for it to do so: few pairs are spread by the joins.
SMALL, MANY = 64, 256


def _by_size(coords: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(pair, rows) of pairs of up to ``SMALL`` coordinates, gathered, and the coordinates of all others; null where there are none or few pairs."""
    size = materialize(coords.groupBy("pair").agg((F.count(F.lit(1)) > SMALL).alias("large")), "pair-sizes")
    held = size.agg(F.count(F.lit(1)).alias("n"), F.count_if("large").alias("large")).first()
    if held.n - held.large < max(1, MANY):
        return None, coords
    large = coords.join(size.where("large").select("pair"), "pair", "left_semi") if held.large else None
    some = coords.join(size.where("large").select("pair"), "pair", "left_anti") if held.large else coords
    tasks = int(coords.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not for AQE to coalesce
    rows = F.collect_list(F.struct(*_ROW)).alias("rows")  # of one small pair
    return some.repartition(tasks, "pair").groupBy("pair").agg(rows), large


_ROW = ("g", "elem", "kind", "i", "x", "y", "x2", "y2")


def place(rows: list[tuple], sides: tuple[int, ...]) -> list[tuple]:
    """(kind, u, v, *locations) of the witnesses of one pair, whose coordinates (g, elem, kind, i, x, y, x2, y2) are integers of any size."""
    segs = [(g, e, k, x, y, x2, y2) for g, e, k, _, x, y, x2, y2 in rows if k != POINT and x2 is not None and (x, y) != (x2, y2)]
    lines = defaultdict(dict)
    for g, e, k, i, x, y, *_ in rows:
        if k == LINE:
            lines[g, e][i] = x, y
    flat = {(g, *p[0]) for (g, _), at in lines.items() for p in (list(at.values()),) if len(set(p)) == 1}
    ends = Counter((g, *at[f(at)]) for (g, _), at in lines.items() if len(set(at.values())) > 1 for f in (min, max))
    dots = {(g, x, y) for g, _, k, _, x, y, *_ in rows if k == POINT}
    alone = {(x, y, 1) for _, x, y in dots | flat}

    cuts = {s[3:]: {(*s[3:5], 1), (*s[5:], 1)} for s in segs}
    own = [(s, min(s[0], s[2]), max(s[0], s[2]), min(s[1], s[3]), max(s[1], s[3])) for s in cuts]
    for n, (s, a, b, c, d) in enumerate(own):
        for t, a2, b2, c2, d2 in own[:n]:
            if a <= b2 and a2 <= b and c <= d2 and c2 <= d:
                met = _meet(*s, *t)
                cuts[s].update(met)
                cuts[t].update(met)
        for p in alone:
            if a <= p[0] <= b and c <= p[1] <= d and (s[2] - s[0]) * (p[1] - s[1]) == (s[3] - s[1]) * (p[0] - s[0]):
                cuts[s].add(p)
    pieces = set()
    for s, at in cuts.items():
        c = 0 if s[1] == s[3] else 1  # along x if level, else along y
        at = sorted(at, key=cmp_to_key(lambda p, q: p[c] * q[2] - q[c] * p[2]))
        pieces.update(zip(at, at[1:]))

    size = 10 ** max(len(str(abs(v))) for r in rows for v in r[4:6])
    found = [(kind, u, v, p) for u, v in pieces for kind, p in zip((MIDDLE, LEFT, RIGHT), beside_middle(u, v, size))]
    nodes = {p for e in pieces for p in e}
    k = (3 * (size + 1)).bit_length() + 1
    found += [(AROUND, p, None, ((p[0] << k) + 1, p[1] << k, 1 << k)) for p in alone - nodes]
    found += [(NODE, p, None, p) for p in alone | nodes]
    near = {g: [s[1:] for s in segs if s[0] == g] for g in sides}
    return [(kind, u, v, *(_location(p, g, near[g], ends, flat, dots) for g in sides)) for kind, u, v, p in found]


def _location(p: tuple[int, int, int], g: int, segs: list[tuple], ends: Counter, flat: set, dots: set) -> str:
    """Where p lies in side g: its segments (elem, kind, ordinates), ends of lines, lines without length and points."""
    px, py, w = p
    odd, rims, rays, line = set(), set(), [], False
    for e, kind, x1, y1, x2, y2 in segs:
        low, high = y1 * w - py, y2 * w - py
        if (low > 0 and high > 0) or (low < 0 and high < 0):
            continue
        o = (x2 - x1) * -low - (y2 - y1) * (px - x1 * w)
        on = o == 0 and min(x1, x2) * w <= px <= max(x1, x2) * w
        if kind == LINE:
            line |= on
            continue
        if on:
            rims.add(e)
            rays += [(e, x2 - x1, y2 - y1)] if p != (x2, y2, 1) else []
            rays += [(e, x1 - x2, y1 - y2)] if p != (x1, y1, 1) else []
        if (low > 0) != (high > 0) and (o > 0 if y2 > y1 else o < 0):
            odd ^= {e}
    if odd - rims or (len(rims) > 1 and covered_all_round(rays, odd)):
        return "I"
    if rims:
        return "B"
    at = (g, px, py) if w == 1 else None
    if ends[at] % 2:
        return "B"
    return "I" if line or at in flat or at in dots or ends[at] else "E"


def _placer(sides: tuple[int, ...], named: bool):
    """``place`` as a function of gathered rows: arrays of kind, u, v and locations, or, unless ``named``, the distinct kinds and locations."""
    locs = [T.StructField(f"loc_{g}", T.StringType()) for g in sides]
    fields = [T.StructField("kind", T.StringType()), *([T.StructField(n, _POINT) for n in "uv"] if named else []), *locs]

    @F.arrow_udf(T.ArrayType(T.StructType(fields)))
    def run(gathered: pa.Array) -> pa.Array:
        columns = [c.to_pylist() for c in gathered.flatten().flatten()]
        whole = lambda c: [None if v is None else int(v) for v in c]
        rows = list(zip(*columns[:4], *map(whole, columns[4:])))
        out, offsets = [], [0]
        at = gathered.offsets.to_pylist()
        for a, b in zip(at, at[1:]):
            some = place(rows[a - at[0] : b - at[0]], sides)
            out += some if named else sorted({(w[0], *w[3:]) for w in some})
            offsets.append(len(out))
        columns = list(zip(*out)) if out else [()] * (len(fields))
        point = lambda c: pa.StructArray.from_arrays([pa.array([None if p is None else str(p[k]) for p in c], pa.string()) for k in range(3)], list("XYW"), mask=pa.array([p is None for p in c], pa.bool_()))
        arrays = [point(c) if named and n in (1, 2) else pa.array(c, pa.string()) for n, c in enumerate(columns)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, [f.name for f in fields]))

    return run


def placed(coords: DataFrame, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(pair, kind, u, v, loc_0, loc_1, ...): the witnesses of pairs with their location in every side."""
    small, large = _by_size(coords)
    if small is None:
        return _placed_by_joins(large, sides)
    rows = small.select("pair", F.explode(_placer(sides, True)("rows")).alias("w")).select("pair", "w.*")
    return rows if large is None else rows.unionByName(_placed_by_joins(large, sides))


def _placed_by_joins(coords: DataFrame, sides: tuple[int, ...]) -> DataFrame:
    found = _numbered(coords)
    return _found_at(found, coords, sides).join(found.select("pair", "n", "id"), ["pair", "n"]).select("pair", "id.kind", "id.u", "id.v", *(f"loc_{k}" for k in sides))


def _numbered(coords: DataFrame) -> DataFrame:
    """``witnesses`` with a number n each, so that they are joined by it and not by the points that make their ids."""
    return materialize(witnesses(coords).withColumn("n", F.monotonically_increasing_id()), "witnesses")


def _found_at(found: DataFrame, coords: DataFrame, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(pair, n, kind, loc_0, loc_1, ...) of numbered witnesses."""
    at = located(found.select("pair", F.struct("n", F.col("id.kind").alias("kind")).alias("id"), "p"), coords, LANES["wide"], sides)
    wide = at.groupBy("pair", "id").agg(*(F.max(F.when(F.col("g") == k, F.col("loc"))).alias(f"loc_{k}") for k in sides))
    return wide.select("pair", "id.n", "id.kind", *(f"loc_{k}" for k in sides))


def relate_witness(pairs: DataFrame) -> DataFrame:
    """(pair, matrix) of pairs (pair, a, b): for each entry the largest dimension of the witnesses that lie so in a and b."""
    coords = materialize(model.on_grid(model.coordinates(pairs), LANES["wide"]), "witness-coordinates")
    small, large = _by_size(coords)
    rows = None if large is None else _found_at(_numbered(large), large).select("pair", "kind", "loc_0", "loc_1")
    if small is not None:
        own = small.select("pair", F.explode(_placer((0, 1), False)("rows")).alias("w")).select("pair", "w.*")
        rows = own if rows is None else rows.unionByName(own)
    dim = F.lit(None)
    for kind, d in DIMENSION.items():
        dim = F.when(F.col("kind") == kind, d).otherwise(dim)
    rows = rows.withColumn("dim", dim)
    best = [F.max(F.when((F.col("loc_0") == a) & (F.col("loc_1") == b), F.col("dim"))).alias(a + b) for a, b in CELLS]
    text = F.concat(*(F.lit("2") if a + b == "EE" else F.coalesce(F.col(a + b).cast("string"), F.lit("F")) for a, b in CELLS))
    return pairs.select("pair").join(rows.groupBy("pair").agg(*best), "pair", "left").select("pair", text.alias("matrix"))


def dual_agreement(pairs: DataFrame, related: DataFrame) -> DataFrame:
    """(pair, matrix, witness, agree): matrices (pair, matrix) of another route beside those of ``relate_witness``."""
    both = related.join(relate_witness(pairs).withColumnRenamed("matrix", "witness"), "pair")
    return both.withColumn("agree", F.col("matrix") == F.col("witness"))
