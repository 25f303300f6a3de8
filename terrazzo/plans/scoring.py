"""Scoring answers of geometry libraries against exact ones, and summaries of the scores.

Tables: ``cases`` (id, family, tags...), ``expected`` (id, status, relate, predicates map, conventions
array, valid_a, valid_b), ``results`` (id, lib, relate, predicates map<string,string>, valid_a, valid_b,
errors map<string,string>); answers are text: 'true', 'false', a matrix, or 'unsupported'. One score row
per case, library and capability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PREDICATES = ("intersects", "disjoint", "touches", "crosses", "overlaps", "within", "contains", "covers", "covered_by", "equals")
VERDICTS = ("correct", "wrong", "error", "convention", "unsupported", "not_reported", "engine_skipped", "engine_error")
TIERS = ("exact", "rounding", "budget", "gross", "topological", "exception")

SCORE = "id string, lib string, family string, capability string, verdict string, tier string, fields array<string>, derived boolean, expected string, got string, cluster string"


def _none() -> Column:
    return F.array().cast("array<string>")


def join_results(cases: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with the answers of each library; a case without an exact answer stays, with nulls."""
    e = expected.select("id", *(F.col(c).alias(f"e_{c}") for c in expected.columns if c != "id"))
    return cases.join(results, "id").join(e, "id", "left")


def _engine_verdict() -> Column:
    return F.when(F.col("e_status") == "engine_skipped", "engine_skipped").when(F.col("e_status") == "engine_error", "engine_error")


def _error(path: str) -> Column:
    return F.coalesce(F.try_element_at("errors", F.lit(path)), F.try_element_at("errors", F.lit("*")))


def cluster_key(signature: Column) -> Column:
    return F.concat_ws("|", "lib", "family", signature)


def _record(rows: DataFrame, capability: str, verdict: Column, fields: Column, derived: Column, expected: Column, got: Column, signature: Column, tier: Column | None = None) -> DataFrame:
    bad = F.col("verdict") == "wrong"
    out = rows.withColumn("verdict", F.coalesce(_engine_verdict(), verdict)).where("verdict IS NOT NULL")
    shown = F.col("verdict").isin("wrong", "convention", "error")
    return out.select(
        "id", "lib", "family", F.lit(capability).alias("capability"), "verdict", (tier if tier is not None else F.lit(None).cast("string")).alias("tier"),
        F.when(shown, fields).otherwise(_none()).alias("fields"), (bad & derived).alias("derived"), F.when(shown, expected).alias("expected"), F.when(shown, got).alias("got"),
        F.when(bad, cluster_key(signature)).alias("cluster"),
    )


def score_relate(joined: DataFrame) -> DataFrame:
    """The matrix as a string; fields name the entries that differ."""
    want, got = F.col("e_relate"), F.col("relate")
    names = F.array(*(F.lit(f"relate.{a}{b}") for a in "IBE" for b in "IBE"))
    differ = F.filter(names, lambda n, i: F.substring(want, i + 1, 1) != F.substring(got, i + 1, 1))
    ok = F.when(want.isNull() & F.col("e_status").isNotNull() & (F.col("e_status") == "invalid"), None)
    verdict = F.when(got == "unsupported", "unsupported").when(got == want, "correct").when(got.isNotNull(), "wrong").when(_error("relate").isNotNull(), "error").otherwise("not_reported")
    verdict = F.when(want.isNotNull(), verdict).otherwise(ok)
    signature = F.concat(F.lit("relate:"), F.array_join(differ, ","))
    return _record(joined, "relate", verdict, differ, F.lit(False), want, F.coalesce(got, _error("relate")), signature)


def score_predicates(joined: DataFrame, derived_from_relate: bool = True) -> DataFrame:
    """One record a case: wrong before error, convention, correct, unsupported and not reported."""
    each = [
        F.struct(
            F.lit(p).alias("p"), F.try_element_at("e_predicates", F.lit(p)).alias("want"), F.try_element_at("predicates", F.lit(p)).alias("got"),
            F.array_contains("e_conventions", p).alias("conv"), _error(f"predicates.{p}").alias("err"),
        ) for p in PREDICATES
    ]
    rows = joined.withColumn("_each", F.filter(F.array(*each), lambda x: x["want"].isNotNull()))
    answered = lambda x: x["got"].isin("true", "false")
    pick = lambda f: F.filter("_each", f)
    wrong = pick(lambda x: answered(x) & (x["got"] != x["want"]) & ~F.coalesce(x["conv"], F.lit(False)))
    conv = pick(lambda x: answered(x) & (x["got"] != x["want"]) & F.coalesce(x["conv"], F.lit(False)))
    err = pick(lambda x: ~F.coalesce(answered(x), F.lit(False)) & (F.coalesce(x["got"], F.lit("")) != "unsupported") & x["err"].isNotNull())
    graded, unsupported = F.exists("_each", answered), F.exists("_each", lambda x: x["got"] == "unsupported")
    rows = rows.withColumn("_w", wrong).withColumn("_c", conv).withColumn("_e", err)
    some = lambda c: F.size(c) > 0
    verdict = F.when(some("_w"), "wrong").when(some("_e"), "error").when(some("_c"), "convention").when(graded, "correct").when(unsupported, "unsupported").otherwise("not_reported")
    verdict = F.when(some("_each"), verdict)
    off = F.when(some("_w"), F.concat("_w", "_c")).when(some("_e"), F.col("_e")).otherwise(F.col("_c"))
    fields = F.transform(off, lambda x: F.concat(F.lit("predicates."), x["p"]))
    text = lambda k: F.array_join(F.transform(off, lambda x: F.concat_ws("=", x["p"], F.coalesce(x[k], F.lit("null")))), ",")
    relate_wrong = F.coalesce((F.col("relate") != F.col("e_relate")) & (F.col("relate") != "unsupported"), F.lit(False))
    signature = F.concat(F.lit("predicates:"), F.array_join(F.transform("_w", lambda x: x["p"]), ","))
    return _record(rows, "predicates", verdict, fields, relate_wrong & F.lit(derived_from_relate), text("want"), F.when(some("_w") | ~some("_e"), text("got")).otherwise(text("err")), signature)


def score_validity(joined: DataFrame) -> DataFrame:
    off = [F.when(F.col(f"valid_{n}").isin("true", "false") & (F.col(f"valid_{n}") != F.col(f"e_valid_{n}")), F.concat(F.lit(f"valid_{n}="), F.col(f"valid_{n}"))) for n in "ab"]
    wrong = F.array_compact(F.array(*off))
    any_ = lambda f: f("a") | f("b")
    err = any_(lambda n: F.col(f"valid_{n}").isNull() & _error(f"valid_{n}").isNotNull())
    graded = any_(lambda n: F.coalesce(F.col(f"valid_{n}").isin("true", "false"), F.lit(False)))
    unsupported = any_(lambda n: F.coalesce(F.col(f"valid_{n}") == "unsupported", F.lit(False)))
    verdict = F.when(F.size(wrong) > 0, "wrong").when(err, "error").when(graded, "correct").when(unsupported, "unsupported").otherwise("not_reported")
    verdict = F.when(F.col("e_valid_a").isNotNull(), verdict)
    fields = F.transform(wrong, lambda x: F.substring_index(x, "=", 1))
    want = F.concat_ws(",", *(F.concat(F.lit(f"valid_{n}="), F.col(f"e_valid_{n}")) for n in "ab"))
    return _record(joined, "validity", verdict, fields, F.lit(False), want, F.array_join(wrong, ","), F.concat(F.lit("validity:"), F.array_join(wrong, ",")))


def grade_overlay(rows: DataFrame) -> DataFrame:
    """``tier`` and ``verdict`` of overlays from their measures.

    rows: error, output_valid, same_components, hausdorff, symdiff_area, delta_rounding, delta (null: none
    documented), perimeters (an upper bound of both), n_vertices.
    """
    tube = lambda d: 2 * d * F.col("perimeters") + F.lit(355.0 / 113.0) * d * d * F.col("n_vertices")
    within = lambda d: (F.col("hausdorff") <= d) & (F.col("symdiff_area") <= tube(d))
    tier = F.when(F.col("error").isNotNull(), "exception").when(~F.col("output_valid") | ~F.col("same_components"), "topological")
    tier = tier.when((F.col("hausdorff") == 0) & (F.col("symdiff_area") == 0), "exact").when(within(F.col("delta_rounding")), "rounding")
    tier = tier.when(F.col("delta").isNotNull() & within(F.col("delta")), "budget").otherwise("gross")
    verdict = F.when(F.col("tier").isin("exact", "rounding", "budget"), "correct").when(F.col("tier") == "exception", "error").otherwise("wrong")
    return rows.withColumn("tier", tier).withColumn("verdict", verdict)


def library_delta(kind: Column, value: Column, largest: Column, ulp: Column, grid: Column) -> Column:
    """The displacement that a library documents for inputs of size ``largest``."""
    return F.when(kind == "relative", value * largest).when(kind == "ulp", value * ulp).when(kind == "absolute", value).when(kind == "grid", value * grid)


def score(cases: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    joined = join_results(cases, expected, results)
    return score_relate(joined).unionByName(score_predicates(joined)).unionByName(score_validity(joined))


def mark_derived(scores: DataFrame, derivations: DataFrame) -> DataFrame:
    """Failures that follow from another failing capability of the same case: ``derivations`` (lib, capability, parent)."""
    failing = scores.where(F.col("verdict").isin("wrong", "error")).select("id", "lib", F.col("capability").alias("parent")).distinct()
    links = derivations.join(failing, ["lib", "parent"]).select("id", "lib", "capability").distinct().withColumn("_derived", F.lit(True))
    out = scores.join(links, ["id", "lib", "capability"], "left")
    return out.withColumn("derived", F.col("derived") | (F.coalesce("_derived", F.lit(False)) & F.col("verdict").isin("wrong", "error"))).drop("_derived")


def summary(scores: DataFrame) -> DataFrame:
    """One row per library and capability: a column per verdict and the share of wrong or failed answers."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    out = scores.groupBy("lib", "capability").agg(F.count(F.lit(1)).alias("records"), *map(count, VERDICTS), F.count(F.when(F.col("derived"), 1)).alias("derived"))
    return out.withColumn("failure_rate", F.round((F.col("wrong") + F.col("error")) / F.col("records"), 6))


def by_family(scores: DataFrame) -> DataFrame:
    """Records and failures by library, family and capability with all their totals, in one pass of grouping sets."""
    fails = F.count(F.when(F.col("verdict").isin("wrong", "error"), 1)).alias("failures")
    return scores.rollup("lib", "family", "capability").agg(F.count(F.lit(1)).alias("records"), fails, F.count_distinct("id").alias("cases"))


def crosstab(cases: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by ``columns`` with a total row."""
    body = cases.groupBy(rows).pivot(columns, values).count().na.fill(0)
    total = body.agg(*(F.sum(v).alias(v) for v in values)).select(F.lit("total").alias(rows), *values)
    return body.unionByName(total)


def clusters(scores: DataFrame, limit: int = 40) -> DataFrame:
    """The largest clusters of wrong answers (a top-k report)."""
    out = scores.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("cases"), F.min("id").alias("first_id"))
    return out.orderBy(F.desc("records"), "cluster").limit(limit)


def examples(scores: DataFrame, sizes: DataFrame, most: int = 5) -> DataFrame:
    """Examples of each cluster: a variant not yet shown first, then small cases; ``sizes``: id, variant, size."""
    rows = scores.where("cluster IS NOT NULL").join(sizes, "id")
    again = F.row_number().over(Window.partitionBy("cluster", "variant").orderBy("size", "id"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("again", "size", "id"))
    return rows.withColumn("again", again).withColumn("rank", rank).where(F.col("rank") <= most).select("cluster", "rank", "id", "variant", "size")


def triage(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Clusters (cluster, lib, family, fields) with the registry entries that explain them and one status."""
    fits = (F.size("libraries") == 0) | F.array_contains("libraries", F.col("lib"))
    fits = fits & ((F.size("families") == 0) | F.array_contains("families", F.col("family")))
    fits = fits & ((F.size("entry_fields") == 0) | F.arrays_overlap("entry_fields", "fields"))
    r = registry.select("entry", "status", "libraries", "families", F.col("fields").alias("entry_fields"))
    hit = found.join(F.broadcast(r), fits, "left")  # the registry is written by hand: some hundred entries
    out = hit.groupBy("cluster").agg(F.sort_array(F.collect_set("entry")).alias("entries"), F.sort_array(F.collect_set("status")).alias("_s"))
    return out.select("cluster", "entries", F.when(F.size("_s") == 0, "unreviewed").when(F.size("_s") == 1, F.get("_s", F.lit(0))).otherwise("mixed").alias("status"))


def changed_records(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two score sets that differ: changed, only before or only after."""
    key = ["id", "lib", "capability"]
    b, a = (x.select(*key, F.struct("verdict", "fields", "expected", "got").alias(n)) for x, n in ((before, "_b"), (after, "_a")))
    both = b.join(a, key, "full").where(~F.col("_b").eqNullSafe(F.col("_a")))
    return both.select(*key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed").alias("change"), F.col("_b.verdict").alias("before"), F.col("_a.verdict").alias("after"))


def plant_faults(answers: DataFrame, every: int = 17) -> DataFrame:
    """Negate every ``every``-th predicate of (id, seq, field, value) in order; numbers come from ranges of seq, not from one task.

    ``seq`` counts from 0 without gaps over all rows.
    """
    hit = (F.col("seq") + 1) % every == 0
    flipped = F.when(F.col("value") == "true", "false").when(F.col("value") == "false", "true").otherwise(F.col("value"))
    return answers.withColumn("mutated", hit).withColumn("value", F.when(hit, flipped).otherwise(F.col("value")))


def controls(scores: DataFrame, mutated: DataFrame) -> DataFrame:
    """(missed, other_changed): planted faults not found, and failures where none was planted. ``mutated``: id."""
    bad = scores.where(F.col("verdict").isin("wrong", "convention")).select("id").distinct().withColumn("_f", F.lit(1))
    both = mutated.select("id").distinct().withColumn("_m", F.lit(1)).join(bad, "id", "full")
    return both.agg(F.count(F.when(F.col("_f").isNull(), 1)).alias("missed"), F.count(F.when(F.col("_m").isNull(), 1)).alias("other_changed"))
