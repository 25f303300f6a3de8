"""Comparing, counting and guarding tables of answers: disagreements, tallies, run times, version locks, failure kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrazzo.session import materialize


def disagreements(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, left, right): every field in which two tables of answers differ, one row each; ids of both tables only."""
    r = right.select("id", *(F.col(f).alias(f"_{f}") for f in fields))
    text = lambda c: F.col(c).cast("string")
    each = [F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), text(f).alias("left"), text(f"_{f}").alias("right"))) for f in fields]
    return left.join(r, "id").select("id", F.explode(F.array_compact(F.array(*each))).alias("d")).select("id", "d.*")


def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side): ids that only one table holds, and those of both, each once."""
    a, b = (t.select("id").distinct() for t in (left, right))
    mark = lambda rows, side: rows.withColumn("side", F.lit(side))
    return mark(a.intersect(b), "both").unionByName(mark(a.exceptAll(b), "left")).unionByName(mark(b.exceptAll(a), "right"))


def tally(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Findings (lib, kind) counted by library, a column for each kind."""
    return found.groupBy("lib").pivot("kind", kinds).count().na.fill(0)


def run_totals(runs: DataFrame) -> DataFrame:
    """(status, n, cpu, wall): runs (id, status, cpu, wall) by status and in all (status 'all')."""
    sums = F.count(F.lit(1)).alias("n"), F.sum("cpu").alias("cpu"), F.sum("wall").alias("wall")
    return runs.rollup("status").agg(*sums, F.grouping("status").alias("_all")).select(F.when(F.col("_all") == 1, "all").otherwise(F.col("status")).alias("status"), "n", "cpu", "wall")


def slowest(runs: DataFrame, most: int = 5) -> DataFrame:
    """The runs that took longest (a top-k report)."""
    return runs.orderBy(F.desc("wall"), "id").limit(most)


def locked_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): answers (id, version, sha256) that may not be written.

    Under one version an answer may be added, but neither change nor vanish.
    """
    b = before.select("id", "version", F.col("sha256").alias("_b"))
    both = b.join(after.select("id", "version", F.col("sha256").alias("_a")), ["id", "version"], "left")
    same = after.select("version").distinct()
    change = F.when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.join(same, "version", "left_semi").withColumn("change", change).where("change IS NOT NULL").select("id", "change")


def error_signature(message: Column) -> Column:
    """A message with its numbers masked, so that one fault on many inputs counts once."""
    return F.regexp_replace(message, r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?", "#")


def failure_kind(error: Column, got: Column, want: Column, got_area: Column, want_area: Column, tolerance: float) -> Column:
    """What is wrong with an answer: 'error:<signature>', 'value', 'area' beyond ``tolerance`` of the larger area, or null."""
    off = F.abs(got_area - want_area) > tolerance * F.greatest(F.abs(got_area), F.abs(want_area))
    return F.when(error.isNotNull(), F.concat(F.lit("error:"), error_signature(error))).when(got != want, "value").when(off, "area")


def same_echo(sent: Column, back: Column) -> Column:
    """Whether a geometry came back with the same types and bits: -0.0 differs from 0.0, NaN equals NaN."""
    return sent.cast("string").eqNullSafe(back.cast("string"))


def every_nth(answers: DataFrame, order: list[str], every: int) -> DataFrame:
    """``answers`` with ``hit``: true for each ``every``-th row of the order, which must be total.

    Rows are counted by range partition, and the counts before a partition are added: no task sees all rows.
    """
    # rows of one partition follow each other in the order; spark_partition_id is read after the sort
    ranged = answers.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before = ranged.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    rows = ranged.withColumn("_n", within).join(F.broadcast(before), "_p")  # a row a partition
    return rows.withColumn("hit", (F.coalesce("_before", F.lit(0)) + F.col("_n")) % every == 0).drop("_p", "_n", "_before", "count")
