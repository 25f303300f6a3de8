"""Overlay of pairs: intersection, union, difference and symmetric difference, from the labelled arrangement.

A face is in the result where the operation holds for its two memberships; a sub-segment bounds the
result's area where its two sides differ, and is a line of the result where it is selected itself and
neither side is. A vertex is a point of the result where it is selected and nothing selected
touches it. Area is Green's sum over the bounding sub-segments, exact as a rational.

The variant ``areal`` keeps polygons only; ``full`` also keeps lines and points.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from terrazzo.functions.exact import format_rational, nearest_double, rational_sum, scaled
from terrazzo.functions.geometry import format_double, st_dim
from terrazzo.operators import model
from terrazzo.operators.noding import Arrangement, arrange, on_either_lane

OPERATIONS = {
    "intersection": lambda a, b: a & b,
    "union": lambda a, b: a | b,
    "difference": lambda a, b: a & ~b,
    "symdifference": lambda a, b: (a | b) & ~(a & b),
}
ALIASES = {"intersect": "intersection", "and": "intersection", "or": "union", "diff": "difference", "minus": "difference", "symdiff": "symdifference", "xor": "symdifference"}


def operation(name: str):
    name = name.lower()
    name = ALIASES.get(name, name)
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation {name}")
    return name, OPERATIONS[name]


def _per_operation(names: tuple[str, ...], columns) -> Column:
    """Array with one struct (op, ...) per operation."""
    return F.array(*(F.struct(F.lit(operation(n)[0]).alias("op"), *columns(operation(n)[1])) for n in names))


def result_edges(arr: Arrangement, names: tuple[str, ...] = tuple(OPERATIONS)) -> DataFrame:
    """(pair, op, role, u, v): role ring (interior to the left of u to v) or line."""

    def columns(holds) -> list[Column]:
        plus, minus = holds(F.col("a_plus"), F.col("b_plus")), holds(F.col("a_minus"), F.col("b_minus"))
        own = holds(F.col("loc_a") != "E", F.col("loc_b") != "E")
        left = F.when(F.col("level"), plus).otherwise(minus)
        role = F.when(plus != minus, "ring").when(plus & minus, "inside").when(own, "line")
        return [role.alias("role"), F.when(left | (plus == minus), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(left | (plus == minus), F.col("v")).otherwise(F.col("u")).alias("v")]

    rows = arr.edges.select("pair", F.explode(_per_operation(names, columns)).alias("r")).select("pair", "r.*")
    return rows.where("role IS NOT NULL")


def result_points(arr: Arrangement, edges: DataFrame, names: tuple[str, ...] = tuple(OPERATIONS)) -> DataFrame:
    """(pair, op, pt) of the isolated points of the result; an anti-join of selected vertices with selected edges."""
    columns = lambda holds: [
        (holds(F.col("loc_a") != "E", F.col("loc_b") != "E") & ~((F.col("degree") == 0) & holds(F.col("face_a"), F.col("face_b")))).alias("own")
    ]
    rows = arr.vertices.select("pair", "pt", F.explode(_per_operation(names, columns)).alias("r")).select("pair", "pt", "r.*").where("own").drop("own")
    touched = edges.select("pair", "op", F.explode(F.array("u", "v")).alias("pt")).distinct()
    return rows.join(touched, ["pair", "op", "pt"], "left_anti")


@F.pandas_udf(T.StringType())
def edge_cross(x1: pd.Series, y1: pd.Series, w1: pd.Series, x2: pd.Series, y2: pd.Series, w2: pd.Series) -> pd.Series:
    """(x1 y2 - x2 y1) / (2 w1 w2): a sub-segment's share of the area to its left."""
    out = []
    for a, b, c, d, e, f in zip(x1, y1, w1, x2, y2, w2):
        out.append(format_rational(Fraction(int(a) * int(e) - int(d) * int(b), 2 * int(c) * int(f))))
    return pd.Series(out, dtype=object)


def unscaled(rows: DataFrame, pairs: DataFrame, column: str, times: int, lane: str) -> DataFrame:
    """Bring areas back from the grid of the wide lane, where a pair is scaled by a power of two."""
    if lane == "narrow":
        return rows
    c = model.coordinates(pairs)
    low = F.least(F.coalesce(F.min(F.least(model.valuation("x"), model.valuation("y"))), F.lit(0)), F.lit(0))
    exps = c.groupBy("pair").agg(low.alias("_e"))
    return rows.join(exps, "pair", "left").withColumn(column, scaled(column, times * F.coalesce("_e", F.lit(0)))).drop("_e")


def overlay(pairs: DataFrame, names: tuple[str, ...] = tuple(OPERATIONS), lane: str | None = None) -> DataFrame:
    """(pair, op, area, ring_edges, line_edges, points, dimension) of each pair and operation; area as exact text."""

    def job(some: DataFrame, k: str) -> DataFrame:
        arr = arrange(some, k)
        edges = result_edges(arr, names)
        parts = [F.col(f"{e}.{c}").cast("string") for e in "uv" for c in "XYW"]
        rings = edges.where("role = 'ring'").withColumn("c", edge_cross(*parts)).groupBy("pair", "op").agg(rational_sum(F.col("c")).alias("area"))
        count = lambda r: F.count(F.when(F.col("role") == r, 1))
        counts = edges.groupBy("pair", "op").agg(count("ring").alias("ring_edges"), count("line").alias("line_edges"))
        points = result_points(arr, edges, names).groupBy("pair", "op").agg(F.count(F.lit(1)).alias("points"))
        every = some.select("pair", F.explode(F.array(*(F.lit(operation(n)[0]) for n in names))).alias("op"))
        out = every.join(rings, ["pair", "op"], "left").join(counts, ["pair", "op"], "left").join(points, ["pair", "op"], "left")
        out = out.na.fill(0, ["ring_edges", "line_edges", "points"]).na.fill("0", ["area"])
        dimension = F.when(F.col("ring_edges") > 0, 2).when(F.col("line_edges") > 0, 1).when(F.col("points") > 0, 0).otherwise(-1)
        return unscaled(out, some, "area", 2, k).select("pair", "op", "area", "ring_edges", "line_edges", "points", dimension.alias("dimension"))

    return job(pairs, lane) if lane else on_either_lane(pairs, job)


# -- assembling one result: the pieces of one pair and operation, bounded by the pair's coordinates --


def _direction(u, v) -> tuple[Fraction, Fraction]:
    return v[0] - u[0], v[1] - u[1]


def _clockwise_first(back, options: list, at):
    """Of outgoing edges, the first one met turning clockwise from direction ``back``."""
    best = None
    for p in options:
        d = _direction(at, p)
        c, s = back[0] * d[0] + back[1] * d[1], d[0] * back[1] - d[1] * back[0]  # angle from d counter-clockwise to back
        key = (0 if s > 0 or (s == 0 and c < 0) else 1, d, p, c, s)
        if best is None or _less_turn(key, best):
            best = key
    return best[2]


def _less_turn(x, y) -> bool:
    if x[0] != y[0]:
        return x[0] < y[0]
    # same half turn: x comes first if turning clockwise from it leads to y
    return x[1][0] * y[1][1] - x[1][1] * y[1][0] < 0


def rings_of(edges: list[tuple]) -> list[list]:
    """Rings of directed edges with the interior to their left, split wherever one returns to a vertex."""
    out_of = defaultdict(list)
    for u, v in edges:
        out_of[u].append(v)
    rings = []
    left = {(u, v) for u, v in edges}
    while left:
        u, v = min(left)
        left.discard((u, v))
        out_of[u].remove(v)
        path, place = [u, v], {u: 0, v: 1}
        while path:
            at, before = path[-1], path[-2]
            nxt = _clockwise_first(_direction(at, before), out_of[at], at)
            out_of[at].remove(nxt)
            left.discard((at, nxt))
            if nxt in place:
                k = place[nxt]
                rings.append(path[k:] + [nxt])
                for p in path[k + 1 :]:
                    place.pop(p)
                path = path[: k + 1]
                if len(path) == 1:
                    break
            else:
                place[nxt] = len(path)
                path.append(nxt)
    return rings


def _area2(ring: list) -> Fraction:
    return sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])), Fraction(0))


def _covers(ring: list, p) -> bool:
    """Even-odd, for points off the ring."""
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (x2 - x1) * (p[1] - y1) / (y2 - y1):
            inside = not inside
    return inside


def _simplified(path: list, keep: set, closed: bool) -> list:
    """The path without vertices in the middle of a straight run, except those to keep."""
    body = path[:-1] if closed else path
    n, out = len(body), []
    for i, p in enumerate(body):
        if closed or 0 < i < n - 1:
            a, b = body[i - 1], body[(i + 1) % n]
            if p not in keep and (p[0] - a[0]) * (b[1] - a[1]) == (p[1] - a[1]) * (b[0] - a[0]):
                continue
        out.append(p)
    return out + out[:1] if closed else out


def _chains(edges: list[tuple], nodes: set) -> list[list]:
    """Maximal paths of undirected edges that end at nodes or where other than two edges meet."""
    near = defaultdict(list)
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    ends = {p for p, q in near.items() if p in nodes or len(q) != 2}
    seen, out = set(), []
    for start in [*sorted(ends), *sorted(near)]:
        for nxt in sorted(near[start]):
            if frozenset((start, nxt)) in seen:
                continue
            path = [start, nxt]
            seen.add(frozenset(path))
            while path[-1] not in ends and path[-1] != start:
                step = [p for p in near[path[-1]] if frozenset((path[-1], p)) not in seen]
                if not step:
                    break
                seen.add(frozenset((path[-1], step[0])))
                path.append(step[0])
            out.append(path)
    return out


def _wkt_of(polygons: list, lines: list, points: list, empty: int, number) -> str:
    xy = lambda p: f"{number(p[0])} {number(p[1])}"
    path = lambda r: "(" + ", ".join(map(xy, r)) + ")"
    kinds = [("POLYGON", ["(" + ", ".join(map(path, p)) + ")" for p in polygons]), ("LINESTRING", list(map(path, lines))), ("POINT", [f"({xy(p)})" for p in points])]
    kinds = [(k, v) for k, v in kinds if v]
    if not kinds:
        return f"{('POINT', 'LINESTRING', 'POLYGON', 'GEOMETRYCOLLECTION')[empty]} EMPTY"  # of the dimension that the operands' types imply
    if len(kinds) == 1:
        name, parts = kinds[0]
        return f"{name} {parts[0]}" if len(parts) == 1 else f"MULTI{name} (" + ", ".join(parts) + ")"
    return "GEOMETRYCOLLECTION (" + ", ".join(f"{k} {p}" for k, parts in kinds for p in parts) + ")"


def _canonical_ring(ring: list, ccw: bool) -> list:
    body = ring[:-1] if (_area2(ring) > 0) == ccw else ring[:-1][::-1]
    k = body.index(min(body))
    body = body[k:] + body[:k]
    return [*body, body[0]]


def parts_of(ring_edges: list[tuple], line_edges: list[tuple], points: list, nodes: set, areal: bool) -> tuple[list, list, list]:
    """Polygons, lines and points of one result in order: shells counter-clockwise, holes clockwise, each from its least point."""
    rings = [_simplified(r, nodes, True) for r in rings_of(ring_edges)]
    shells = [r for r in rings if _area2(r) > 0]
    shells.sort(key=_area2)
    held: list[list] = [[] for _ in shells]
    for h in (r for r in rings if _area2(r) < 0):
        probe = ((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2)
        held[next(i for i, s in enumerate(shells) if _covers(s, probe))].append(_canonical_ring(h, False))
    polygons = sorted([_canonical_ring(s, True), *sorted(hs)] for s, hs in zip(shells, held))
    lines = [] if areal else sorted(min(c, c[::-1]) for c in (_simplified(p, nodes, False) for p in _chains(line_edges, nodes)))
    return polygons, lines, [] if areal else sorted(points)


def assemble(ring_edges: list[tuple], line_edges: list[tuple], points: list, nodes: set, areal: bool, empty: int, number) -> str:
    """Well-known text of one result, in the order of ``parts_of``."""
    return _wkt_of(*parts_of(ring_edges, line_edges, points, nodes, areal), empty, number)


def _texts(areal: bool):
    """The result as text with rational and with nearest double coordinates, from the pieces (role, u, v) of one pair."""
    display = lambda q: format_double(nearest_double(q))

    def build(pieces: pd.Series, empty: pd.Series, exponent: pd.Series) -> pd.DataFrame:
        out = []
        for some, dim, e in zip(pieces, empty, exponent):
            unit = Fraction(2) ** (0 if pd.isna(e) else int(e))

            def point(t: str, unit=unit):
                x, y, w = map(int, t.split())
                return Fraction(x, w) * unit, Fraction(y, w) * unit

            of = {role: [] for role in ("ring", "line", "point", "node")}
            for r in some:
                of[r["role"]].append((point(r["u"]), point(r["v"])) if r["role"] in ("ring", "line") else point(r["u"]))
            parts = parts_of(of["ring"], of["line"], of["point"], set(of["node"]), areal)
            out.append((_wkt_of(*parts, int(dim), format_rational), _wkt_of(*parts, int(dim), display)))
        return pd.DataFrame(out, columns=["exact", "wkt"])

    return F.pandas_udf(build, T.StructType([T.StructField(c, T.StringType()) for c in ("exact", "wkt")]))


def overlay_geometry(pairs: DataFrame, name: str, areal: bool = False, lane: str | None = None) -> DataFrame:
    """(pair, exact, wkt): the result of one operation with rational and with nearest double coordinates."""
    name, _ = operation(name)
    if lane is None:
        return on_either_lane(pairs, lambda some, k: overlay_geometry(some, name, areal, k))
    arr = arrange(pairs, lane)
    edges = result_edges(arr, (name,))
    points = result_points(arr, edges, (name,))
    none = F.lit(None).cast(f"{arr.lane.point_type}")
    nodes = arr.vertices.where("degree <> 2").select("pair", F.lit("node").alias("role"), F.col("pt").alias("u"), none.alias("v"))
    rows = edges.where("role <> 'inside'").select("pair", "role", "u", "v").unionByName(points.select("pair", F.lit("point").alias("role"), F.col("pt").alias("u"), none.alias("v"))).unionByName(nodes)
    text = lambda c: F.concat_ws(" ", *(F.col(f"{c}.{k}").cast("string") for k in "XYW"))
    empty = {"intersection": F.least, "difference": lambda a, b: a}.get(name, F.greatest)(st_dim(F.col("a")), st_dim(F.col("b")))
    rows = pairs.select("pair", F.lit(2).alias("empty") if areal else empty.alias("empty")).join(rows.select("pair", "role", text("u").alias("u"), text("v").alias("v")), "pair", "left")
    if lane == "wide":
        c = model.coordinates(pairs)
        low = F.least(F.coalesce(F.min(F.least(model.valuation("x"), model.valuation("y"))), F.lit(0)), F.lit(0))
        rows = rows.join(c.groupBy("pair").agg(low.alias("e")), "pair", "left")
    else:
        rows = rows.withColumn("e", F.lit(0))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not for AQE to coalesce
    piece = F.when(F.col("role").isNotNull(), F.struct("role", "u", "v"))
    rows = rows.repartition(tasks, "pair").groupBy("pair").agg(F.first("empty").alias("empty"), F.first("e").alias("e"), F.collect_list(piece).alias("pieces"))  # of one pair
    return rows.withColumn("r", _texts(areal)("pieces", "empty", "e")).select("pair", "r.exact", "r.wkt")


def consistency_problems(related: DataFrame, overlaid: DataFrame) -> DataFrame:
    """(pair, problem): where a pair's areas or dimensions contradict its matrix. ``related``: pair, matrix, area_a, area_b."""
    wide = overlaid.groupBy("pair").pivot("op", list(OPERATIONS)).agg(F.first("area").alias("area"), F.first("dimension").alias("dim"))
    top = F.greatest(*(F.when(F.substring("matrix", k, 1) == "F", -1).otherwise(F.try_to_number(F.substring("matrix", k, 1), F.lit("9")).cast("int")) for k in (1, 2, 4, 5)))
    rows = related.join(wide, "pair").withColumn("_top", top)
    checks = {
        "intersection has another dimension than the matrix": F.col("intersection_dim") != F.col("_top"),
        "area of the union is not the sum less the intersection": _total("union_area", "intersection_area") != _total("area_a", "area_b"),
        "symmetric difference is not the union less the intersection": _total("symdifference_area", "intersection_area") != F.col("union_area"),
    }
    found = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in checks.items()))))
    return rows.select("pair", found.alias("problem"))


@F.pandas_udf(T.StringType())
def _add(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([format_rational(Fraction(a) + Fraction(b)) for a, b in zip(x, y)], dtype=object)


def _total(x: str, y: str) -> Column:
    return _add(F.col(x), F.col(y))
