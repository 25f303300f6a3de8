"""Exact rationals as text "n" or "n/d": small Arrow helpers for sums, extremes, roots and conversions."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def format_rational(q: Fraction) -> str:
    return str(q.numerator) if q.denominator == 1 else f"{q.numerator}/{q.denominator}"


def nearest_double(q: Fraction) -> float:
    """Nearest double, ties to even; beyond the range, infinity."""
    try:
        return q.numerator / q.denominator
    except OverflowError:
        return math.inf if q > 0 else -math.inf


@F.pandas_udf(T.StringType())
def to_rational(x: pd.Series) -> pd.Series:
    """The exact value of a double; null for what is not finite."""
    return pd.Series([format_rational(Fraction(v)) if v is not None and math.isfinite(v) else None for v in x], dtype=object)


@F.pandas_udf(T.DoubleType())
def rational_to_double(q: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else nearest_double(Fraction(v)) for v in q], dtype="Float64")


@F.pandas_udf(T.StringType())
def rational(n: pd.Series, d: pd.Series) -> pd.Series:
    """n / d of integers given as text or decimals, in lowest terms."""
    return pd.Series([None if a is None or b is None else format_rational(Fraction(int(a), int(b))) for a, b in zip(n, d)], dtype=object)


@F.pandas_udf(T.StringType())
def _sum_of(terms: pd.Series) -> pd.Series:
    out = []
    for some in terms:
        values = [Fraction(v) for v in some]
        while len(values) > 1:  # in pairs, so that denominators grow slowly
            values = [sum(values[i : i + 2], Fraction(0)) for i in range(0, len(values), 2)]
        out.append(format_rational(values[0] if values else Fraction(0)))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _min_of(terms: pd.Series) -> pd.Series:
    return pd.Series([format_rational(min(map(Fraction, some))) if len(some) else None for some in terms], dtype=object)


def rational_sum(q: Column) -> Column:
    """Aggregate: the exact sum of a group's rationals. Groups are the parts of one geometry or pair."""
    return _sum_of(F.collect_list(q))


def rational_min(q: Column) -> Column:
    """Aggregate: the least of a group's rationals."""
    return _min_of(F.collect_list(q))


@F.pandas_udf(T.StringType())
def scaled(q: pd.Series, e: pd.Series) -> pd.Series:
    """q * 2 ** e."""
    return pd.Series([None if v is None else format_rational(Fraction(v) * Fraction(2) ** int(k)) for v, k in zip(q, e)], dtype=object)


@F.pandas_udf(T.DoubleType())
def ulp(x: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else math.ulp(v) for v in x], dtype="Float64")


@F.pandas_udf(T.DoubleType())
def nudge(x: pd.Series, k: pd.Series) -> pd.Series:
    """The double k steps above x (below for negative k)."""
    return pd.Series([None if v is None else math.nextafter(v, math.copysign(math.inf, n), steps=abs(int(n))) for v, n in zip(x, k)], dtype="Float64")


@F.pandas_udf(T.StringType())
def double_text(x: pd.Series) -> pd.Series:
    """Shortest text that reads back as the same double."""
    from terrazzo.functions.geometry import format_double

    return pd.Series([None if v is None else format_double(v) for v in x], dtype=object)


ENCLOSURE = T.StructType([T.StructField("lo", T.StringType()), T.StructField("hi", T.StringType()), T.StructField("rounded", T.DoubleType())])


def sqrt_bounds(q: Fraction, bits: int = 160) -> tuple[Fraction, Fraction]:
    """Rational bounds of a square root, 2 ** -bits apart relative to its size at most (equal where it is rational)."""
    n, d = q.numerator, q.denominator
    rn, rd = math.isqrt(n), math.isqrt(d)
    if rn * rn == n and rd * rd == d:
        return Fraction(rn, rd), Fraction(rn, rd)
    shift = max(0, 2 * bits + d.bit_length() - n.bit_length())
    shift += shift % 2
    low = math.isqrt((n << shift) // d)
    return Fraction(low, 1 << shift // 2), Fraction(low + 1, 1 << shift // 2)


@F.pandas_udf(ENCLOSURE)
def sqrt_sum(terms: pd.Series) -> pd.DataFrame:
    """Certified enclosure of the sum of the square roots of an array of rationals."""
    out = []
    for some in terms:
        low = high = Fraction(0)
        for q in some if some is not None else ():
            a, b = sqrt_bounds(Fraction(q))
            low, high = low + a, high + b
        out.append((format_rational(low), format_rational(high), nearest_double((low + high) / 2)))
    return pd.DataFrame(out, columns=["lo", "hi", "rounded"])


DYADIC = T.StructType([T.StructField("m", T.StringType()), T.StructField("e", T.IntegerType())])


@F.pandas_udf(DYADIC)
def dyadic(x: pd.Series) -> pd.DataFrame:
    """x as m * 2 ** e with m odd (0 and 0 for zero); null for what is not finite."""
    out = []
    for v in x:
        if v is None or not math.isfinite(v):
            out.append((None, None))
            continue
        n, d = float(v).as_integer_ratio()
        twos = (n & -n).bit_length() - 1 if n else 0
        out.append((str(n >> twos), twos - (d.bit_length() - 1)))
    return pd.DataFrame({"m": pd.Series([m for m, _ in out], dtype=object), "e": pd.Series([e for _, e in out], dtype="Int32")})


def root_weighted_mean(terms: Iterable[tuple]) -> tuple[str, str, float] | None:
    """Certified enclosure of sum(sqrt(q) m) / sum(sqrt(q) n) over (q, m, n): rationals q and m, a count n; None where all q are zero."""
    low = high = top_low = top_high = Fraction(0)
    for q, m, n in terms:
        (a, b), m = _root_of(q), Fraction(m)
        low, high = low + a * n, high + b * n
        top_low, top_high = top_low + min(a * m, b * m), top_high + max(a * m, b * m)
    if low == 0:
        return None
    lo, hi = min(top_low / low, top_low / high), max(top_high / low, top_high / high)
    return format_rational(lo), format_rational(hi), nearest_double((lo + hi) / 2)


@lru_cache(1 << 12)
def _root_of(q: str) -> tuple[Fraction, Fraction]:
    return sqrt_bounds(Fraction(q))
