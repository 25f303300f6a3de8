"""Exact deduplication by skew-safe combining.

Three combining stages, each comparing whole texts (the text itself is a grouping key):

1. map tasks combine their equal texts before anything is shuffled;
2. the groups of (digest, salt, text) meet, the salt being that of the map task, so that a text held
   by a third of all rows is dealt over ``SALTS`` tasks and each map task sends one row of it;
3. the winners of the salts meet by (digest, text).

The table of winners has no texts. Rows find their winner by (digest, salt of the row's number), so
that no hot digest meets in one task either, whatever ids its rows have. Digests that stand for
several texts (none with SHA-256, many with the weak digests of the tests) are found in that table,
and their rows are joined by the whole text.

Defined results: a null text equals the empty text; a null doc_id loses against any other, and a
group of null doc_ids keeps one row; rows repeated with their doc_id are one document; an empty
table gives an empty result; other columns pass through ``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.llm.common import SALTS, materialize, skew_safe_lookup, text_or_empty, unused


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _combine(rows: DataFrame) -> DataFrame:
    """Stages 1 to 3 over (doc_id, _digest, _text): one row a text."""
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    by_salt = salted.groupBy("_digest", "_salt", "_text").agg(F.max("doc_id").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return by_salt.groupBy("_digest", "_text").agg(F.max("_m").alias("keep_id"), F.sum("_n").alias("group_size"))


def decide(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, keep_id, group_size (long), kept."""
    rows = docs.select("doc_id", text_or_empty().alias("_text")).withColumn("_digest", digest(F.col("_text")))
    won = materialize(_combine(rows).drop("_text"), "exact-winners")
    shared = won.groupBy("_digest").count().where("count > 1").select("_digest")
    collides = not shared.isEmpty()
    if collides:
        won = won.join(shared, "_digest", "left_anti")

    keyed = materialize(rows.select("doc_id", "_digest", F.monotonically_increasing_id().alias("_row")), "exact-rows")
    out = skew_safe_lookup(keyed, won, "_digest", "_row").drop("_row")
    if collides:
        hot = rows.join(shared, "_digest", "left_semi")
        by_text = _combine(hot).drop("_digest")
        out = out.unionByName(hot.join(by_text, "_text").drop("_text"))
    return out.select("doc_id", F.col("_digest").alias("text_digest"), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the largest doc_id."""
    i, d, own, full = unused(docs, "_id", "_dg", "_own_digest", "_full")
    kept = materialize(decide(docs, digest).where("kept").select(F.col("doc_id").alias(i), F.col("text_digest").alias(d)), "exact-kept")
    repeated = kept.groupBy(i, d).count().where("count > 1").drop("count")
    keyed = docs.withColumn(own, digest(text_or_empty()))
    match = [F.col("doc_id").eqNullSafe(F.col(i)), F.col(own) == F.col(d)]
    if repeated.isEmpty():
        return keyed.join(kept, match, "left_semi").drop(own)
    single = kept.join(repeated, [kept[i].eqNullSafe(repeated[i]), kept[d] == repeated[d]], "left_anti")
    once = keyed.join(single, match, "left_semi")
    # the rows that repeat their doc_id and text are few; of each set of them one stays
    several = keyed.join(repeated, match, "left_semi").withColumn(full, text_or_empty()).dropDuplicates(["doc_id", full]).drop(full)
    return once.unionByName(several).drop(own)
