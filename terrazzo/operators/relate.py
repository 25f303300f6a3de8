"""DE-9IM relate and the named predicates.

The matrix of a pair is the largest dimension among its witnesses for each (location in a, location
in b): vertices count 0, sub-segments 1, their two sides 2, and the outside of both always 2.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.functions.geometry import POLYGON, st_dim, st_isempty, st_realdim
from terrazzo.operators import validity
from terrazzo.operators.noding import NAMES, Arrangement, arrange, on_either_lane
from terrazzo.session import materialize

CELLS = list(product("IBE", "IBE"))


def witnesses(arrangement: Arrangement) -> DataFrame:
    """(pair, dim, la, lb) of every vertex, sub-segment and side."""
    e, v = arrangement.edges, arrangement.vertices
    side = lambda s: F.struct(F.lit(2).alias("dim"), *(F.when(F.col(f"{n}_{s}"), "I").otherwise("E").alias(f"l{n}") for n in NAMES))
    own = F.struct(F.lit(1).alias("dim"), *(F.col(f"loc_{n}").alias(f"l{n}") for n in NAMES))
    lines = e.select("pair", F.explode(F.array(own, side("plus"), side("minus"))).alias("w")).select("pair", "w.*")
    return lines.unionByName(v.select("pair", F.lit(0).alias("dim"), F.col("loc_a").alias("la"), F.col("loc_b").alias("lb")))


def matrices(arrangement: Arrangement) -> DataFrame:
    """(pair, matrix)."""
    best = [F.max(F.when((F.col("la") == a) & (F.col("lb") == b), F.col("dim"))).alias(a + b) for a, b in CELLS]
    found = witnesses(arrangement).groupBy("pair").agg(*best)
    text = F.concat(*(F.lit("2") if a + b == "EE" else F.coalesce(F.col(a + b).cast("string"), F.lit("F")) for a, b in CELLS))
    return arrangement.pairs.select("pair").join(found, "pair", "left").select("pair", text.alias("matrix"))


def relate(pairs: DataFrame, lane: str | None = None) -> DataFrame:
    """(pair, matrix) of pairs (pair, a, b); each pair on the lane that its coordinates need, or on the one named."""
    job = lambda p, k: matrices(arrange(p, k, own_lines=False))
    return job(pairs, lane) if lane else on_either_lane(pairs, job)


#: Segments and meeting points of a pair beyond which it is left out, with a status.
BUDGET = 200_000


def refused(pairs: DataFrame) -> DataFrame:
    """(pair, status) of pairs that no matrix is given for: "invalid_a: code" or "invalid_b: code".

    Refused are ordinates that are not finite, and polygons that are not valid: rings that are not closed, too short or
    flat, that cross or touch themselves or each other, holes outside their shell, parts in each other.
    """
    ident = F.struct("pair", F.col("s.side").alias("side"))
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("geom")) for n in NAMES)))
    geoms = pairs.select("pair", sides.alias("s")).select(ident.alias("id"), "s.geom")
    flat = F.flatten(F.flatten(F.transform("geom.elements", lambda e: e["rings"])))
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    strange = geoms.where(F.exists(flat, lambda p: odd(p["x"]) | odd(p["y"]))).select("id", F.lit(validity.CODES[0]).alias("code"))
    areas = F.filter("geom.elements", lambda e: e["kind"] == POLYGON)
    areal = geoms.where(F.size(areas) > 0).withColumn("geom", F.struct(F.col("geom.type").alias("type"), areas.alias("elements")))
    reasons = validity.validate(areal).where("NOT valid").select("id", F.get("reasons", F.lit(0)).alias("code"))
    found = strange.unionByName(reasons).groupBy("id").agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, validity.CODES)), F.col("code")).alias("k"), "code")).alias("m"))
    return found.groupBy("id.pair").agg(F.min(F.concat(F.lit("invalid_"), F.col("id.side"), F.lit(": "), F.col("m.code"))).alias("status"))


def relate_checked(pairs: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(pair, matrix, status): "ok", a reason of ``refused``, or "engine_skipped" for pairs over budget; the matrix is null unless ok."""
    bad = materialize(refused(pairs), "refused")
    sound = pairs.join(bad, "pair", "left_anti")

    def job(some: DataFrame, lane: str) -> DataFrame:
        arrangement = arrange(some, lane, budget)
        out = matrices(arrangement).withColumn("status", F.lit("ok"))
        return out if arrangement.over is None else out.unionByName(arrangement.over.select("pair", F.lit(None).cast("string").alias("matrix"), F.lit("engine_skipped").alias("status")))

    return on_either_lane(sound, job).unionByName(bad.select("pair", F.lit(None).cast("string").alias("matrix"), "status"))


def cell_realizers(pairs: DataFrame, lane: str = "narrow") -> DataFrame:
    """(pair, la, lb, dim, n): how many witnesses realise each entry at its dimension."""
    w = witnesses(arrange(pairs, lane)).groupBy("pair", "la", "lb", "dim").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("pair", "la", "lb").agg(F.max(F.struct("dim", "n")).alias("s")).select("pair", "la", "lb", "s.dim", "s.n")


def entry(m: Column, k: int) -> Column:
    return F.substring(m, k + 1, 1)


def is_set(m: Column, *at: int) -> Column:
    """Whether any of these entries of the matrix is not F."""
    out = F.lit(False)
    for k in at:
        out = out | (entry(m, k) != "F")
    return out


def relate_pattern(m: Column, pattern: str) -> Column:
    """Whether a matrix matches a pattern of T, F, *, 0, 1, 2 (either case)."""
    if len(pattern) != 9 or set(pattern.upper()) - set("TF*012"):
        raise ValueError(f"not a pattern: {pattern}")
    return m.rlike("^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in pattern.upper()) + "$")


def transpose(m: Column) -> Column:
    """The matrix of the swapped pair."""
    return F.concat(*(entry(m, 3 * j + i) for i in range(3) for j in range(3)))


def named_predicates(m: Column, da: Column, db: Column) -> dict[str, Column]:
    """The named predicates of a matrix, given the real dimensions of both geometries."""
    p = lambda t: relate_pattern(m, t)
    some = (da >= 0) & (db >= 0)
    flat = F.lit(False)
    return {
        "disjoint": p("FF*FF****"),
        "intersects": ~p("FF*FF****"),
        "touches": some & ~((da == 0) & (db == 0)) & ~is_set(m, 0) & is_set(m, 1, 3, 4),
        "crosses": F.when(some & (da < db), p("T*T******")).when(some & (da > db), p("T*****T**")).when((da == 1) & (db == 1), p("0********")).otherwise(flat),
        "overlaps": F.when(some & (da == db), F.when(da == 1, p("1*T***T**")).otherwise(p("T*T***T**"))).otherwise(flat),
        "contains": p("T*****FF*"),
        "within": p("T*F**F***"),
        "covers": is_set(m, 0, 1, 3, 4) & p("******FF*"),
        "covered_by": is_set(m, 0, 1, 3, 4) & p("**F**F***"),
        "equals": ((da == -1) & (db == -1)) | ((da == db) & p("T*F**FFF*")),
    }


def contains_properly(m: Column) -> Column:
    return relate_pattern(m, "T**FF*FF*")


def conventions(empty_a: Column, empty_b: Column) -> Column:
    """Names of predicates whose value on empty geometries is a convention that libraries differ on."""
    both = F.array(F.lit("equals"))
    of = lambda c, *names: F.when(c, F.array(*map(F.lit, names)))
    none = F.array().cast("array<string>")
    return F.concat(
        F.coalesce(F.when(empty_a & empty_b, both), none), F.coalesce(of(empty_b, "contains", "covers"), none), F.coalesce(of(empty_a, "within", "covered_by"), none)
    )


def predicates(pairs: DataFrame, lane: str | None = None) -> DataFrame:
    """(pair, matrix, dim_a, dim_b, the ten predicates, conventions)."""
    dims = pairs.select("pair", *(f(F.col(n)).alias(f"{c}_{n}") for n in NAMES for c, f in (("dim", st_realdim), ("type_dim", st_dim), ("empty", st_isempty))))
    rows = relate(pairs, lane).join(dims, "pair")
    named = named_predicates(F.col("matrix"), F.col("dim_a"), F.col("dim_b"))
    return rows.select("pair", "matrix", "dim_a", "dim_b", *(c.alias(n) for n, c in named.items()), conventions(F.col("empty_a"), F.col("empty_b")).alias("conventions"))


def matrix_problems(m: Column, da: Column, db: Column) -> Column:
    """What of a matrix contradicts the dimensions of its geometries."""
    dim = lambda k: F.when(entry(m, k) == "F", -1).otherwise(F.try_to_number(entry(m, k), F.lit("9")).cast("int"))
    checks = {
        "outside of both is not 2": entry(m, 8) != "2",
        "interior of a has another dimension": (da >= 0) & (F.greatest(dim(0), dim(1), dim(2)) != da),
        "interior of b has another dimension": (db >= 0) & (F.greatest(dim(0), dim(3), dim(6)) != db),
        "boundary of a is not below its interior": F.greatest(dim(3), dim(4), dim(5)) >= F.greatest(da, F.lit(0)),
        "boundary of b is not below its interior": F.greatest(dim(1), dim(4), dim(7)) >= F.greatest(db, F.lit(0)),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in checks.items())))
