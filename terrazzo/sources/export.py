"""Text exports of cases with exact answers: test files of other geometry libraries, one text per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.functions.geometry import st_astext


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def identifier(c: Column) -> Column:
    """A name that is an identifier in most languages."""
    return F.concat(F.lit("case_"), F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_")))


def _with_text(cases: DataFrame) -> DataFrame:
    return cases.withColumn("_a", st_astext("a")).withColumn("_b", st_astext("b"))


def jts_xml(cases: DataFrame) -> DataFrame:
    """(pair, value): <case> elements with a relate test; cases: pair, a, b, matrix."""
    line = F.format_string(
        '<case><desc>%s</desc><a>%s</a><b>%s</b><test><op name="relate" arg1="A" arg2="B" arg3="%s">true</op></test></case>', _xml(F.col("pair").cast("string")), _xml(F.col("_a")), _xml(F.col("_b")), F.col("matrix")
    )
    return _with_text(cases).select("pair", line.alias("value"))


def pytest_module(cases: DataFrame) -> DataFrame:
    """(pair, value): parameters of a pytest module for a WKT-based library."""
    return _with_text(cases).select("pair", F.format_string("    pytest.param(%s, %s, '%s', id='%s'),", F.concat(F.lit("'"), "_a", F.lit("'")), F.concat(F.lit("'"), "_b", F.lit("'")), F.col("matrix"), identifier(F.col("pair").cast("string"))).alias("value"))


def boost_cpp(cases: DataFrame) -> DataFrame:
    """(pair, value): calls of a C++ relate test, WKT without blanks after commas."""
    tight = lambda c: F.replace(F.col(c), F.lit(", "), F.lit(","))
    return _with_text(cases).select("pair", F.format_string('    check("%s", "%s", "%s", "%s");', identifier(F.col("pair").cast("string")), tight("_a"), tight("_b"), F.col("matrix")).alias("value"))


def rust_tests(cases: DataFrame) -> DataFrame:
    """(pair, value): Rust tests whose numbers are float literals."""
    floats = lambda c: F.regexp_replace(F.col(c), r"(?<![\d.e])(-?\d+)(?=[ ,)])(?!\.)", "$1.0")
    body = '#[test] fn %s() { relate_is(wkt!(%s), wkt!(%s), "%s"); }'
    return _with_text(cases).select("pair", F.format_string(body, identifier(F.col("pair").cast("string")), floats("_a"), floats("_b"), F.col("matrix")).alias("value"))


def integer_polygons(cases: DataFrame, most: int = 62) -> DataFrame:
    """(pair, value, skipped): polygons of integer clippers; cases whose integers pass 2 ** ``most`` are marked, not written."""
    flat = lambda g: F.flatten(F.flatten(F.transform(F.col(g)["elements"], lambda e: e["rings"])))
    fits = lambda g: F.forall(flat(g), lambda p: (p["x"] == F.floor(p["x"])) & (p["y"] == F.floor(p["y"])) & (F.abs(p["x"]) < 2.0**most) & (F.abs(p["y"]) < 2.0**most))
    ring = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(",", p["x"].cast("bigint"), p["y"].cast("bigint"))), " ")
    paths = lambda g: F.array_join(F.transform(F.flatten(F.transform(F.col(g)["elements"], lambda e: e["rings"])), ring), "\n")
    ok = fits("a") & fits("b")
    return cases.select("pair", F.when(ok, F.concat(F.lit("SUBJECTS\n"), paths("a"), F.lit("\nCLIPS\n"), paths("b"))).alias("value"), (~ok).alias("skipped"))
