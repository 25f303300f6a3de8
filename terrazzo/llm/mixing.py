"""Mixing sources to target weights along a time-varying curriculum.

Sources in code point order weigh 1, 2, 3, repeating, and share the words of all documents; no source
may give more than ``MAX_EPOCHS`` times its words, and what it cannot give is shared anew by weight.

Each source is used at a rate that changes linearly over training time t in [0, 1]: light sources
early, heavy ones late. The integral of the rate is the source's cumulative demand, and inverting it
gives each copy of a document its position in training. A source's documents are read in the order
of a hash of their ids and texts, as often as the target needs; the last pass ends inside one document. Mixed
documents are sorted by range of position.

Running totals inside a source come from equal hash buckets: rows are summed inside their bucket,
buckets inside their group of ``GROUP_BUCKETS``, and groups inside their source, so that a source with
a third of all rows is spread over all its buckets and no task sorts more than a bucket or the totals
of a group.

Defined results: a null text has size 0, takes 0 words and has no position; a null source is a source
of its own, after all others; rows repeated with their doc_id are counted each, and rows that repeat both
doc_id and text stay in one bucket and share their positions in ``mix``; an empty table gives
an empty result; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrazzo.llm.common import WORD, materialize, text_or_empty, unused

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of a bucket, about.
BUCKET_ROWS = 1000
#: Buckets whose totals are summed together.
GROUP_BUCKETS = 1000
#: Change of the usage rate over training time, by weight: rate(t) = 1 + slope * (2 t - 1).
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last, without sorting them in one task.

    Sources are sorted into ranges; each range counts its own, and earlier ranges' counts are added.
    """
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, "source-ranges")
    counts = parts.groupBy("_part").count()
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: as many as shuffle partitions
    before = counts.select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("_own", own).join(before, "_part").withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, n_docs, weight, target.

    The words per unit of weight, over sources that are not at their limit, rise from round to round
    until no further source reaches its limit; a round is one aggregate over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(ranked(sources).withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = MAX_EPOCHS * F.col("source_size")
    free, level, full = total, 0.0, -1
    while True:
        at_limit = F.col("weight") * F.lit(level) >= cap
        s = sources.agg(F.count(F.when(at_limit, 1)).alias("k"), F.sum(F.when(at_limit, cap)).alias("taken"), F.sum(F.when(~at_limit, F.col("weight"))).alias("w")).first()
        if s["k"] == full or not s["w"]:
            break
        full, free = s["k"], total - (s["taken"] or 0)
        level = free / s["w"]
    target = F.when(F.col("weight") * F.lit(level) >= cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def training_time(share: Column, slope: Column) -> Column:
    """The time t at which the integral of 1 + slope (2 t - 1), slope t**2 + (1 - slope) t, reaches ``share``."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.least(F.lit(1.0), 2 * share / ((1 - slope) + root))


def row_key() -> Column:
    """A hash of a row's doc_id and text: rows that share or lack an id still have places of their own."""
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(text_or_empty())))


def plan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, copies, position.

    ``copies`` counts the passes that take at least half of the document; ``position`` is the training
    time of the middle of its first pass, null if nothing of it is taken.
    """
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    sized = materialize(docs.select("doc_id", F.col("source").cast("string"), size.alias("size"), row_key().alias("_key")), "sizes")
    goals = materialize(targets(sized), "targets")

    n_buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * n_buckets / 2**32).cast("bigint")
    rows = sized.withColumn("_bucket", bucket).withColumn("_source", F.concat(F.lit("s"), F.col("source"))).withColumn("_source", F.coalesce("_source", F.lit("")))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_group", F.expr(f"_bucket DIV {GROUP_BUCKETS}"))
    before = lambda keys, by, v: F.coalesce(F.sum(v).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("_source", "_group").agg(F.sum("_sum").alias("_total"))
    groups = groups.select("_source", "_group", before(["_source"], "_group", "_total").alias("_from"))
    offsets = sums.withColumn("_at", before(["_source", "_group"], "_bucket", "_sum")).join(groups, ["_source", "_group"])
    offsets = offsets.select("_source", "_bucket", (F.col("_from") + F.col("_at")).alias("_offset"))
    goals = goals.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    offsets = offsets.join(goals, "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_source", "_bucket"])
    start = F.col("_offset") + F.col("_in")
    # whole passes over the source, then the words of the last pass, which is cut where the target is reached
    goal = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    last = F.greatest(F.lit(0), F.least(F.col("size"), goal - passes * F.col("source_size") - start))
    taken = passes * F.col("size") + last
    copies = passes + F.when((2 * last >= F.col("size")) & (last > 0), 1).otherwise(0)
    slope = F.element_at(F.create_map(*(F.lit(x) for kv in SLOPES.items() for x in kv)), F.col("weight"))
    share = F.least(F.lit(1.0), (start + F.col("size") / 2) / F.greatest(goal, F.lit(1)))
    placed = placed.withColumn("taken", taken.cast("bigint")).withColumn("copies", copies.cast("int"))
    position = F.when(F.col("taken") > 0, training_time(share, slope))
    placed = placed.withColumn("position", position).withColumn("_start", start).withColumn("_goal", goal).withColumn("_slope", slope)
    return placed.select("doc_id", "size", "source", "source_size", "target", "taken", "copies", "position", "_key", "_start", "_goal", "_slope")


def order(docs: DataFrame) -> DataFrame:
    """``plan`` sorted by range of position, documents without one last."""
    planned = plan(docs).drop("_key", "_start", "_goal", "_slope")
    return planned.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it (a pass that takes less than half of it is left out), by position."""
    planned = plan(docs).where("copies > 0")
    share = F.least(F.lit(1.0), (F.col("_start") + F.col("_pass") * F.col("source_size") + F.col("size") / 2) / F.greatest("_goal", F.lit(1)))
    copies = planned.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("_position", training_time(share, F.col("_slope")))
    # rows that repeat doc_id and text share the earliest position of each pass; joined one to one they would multiply
    k, n, at = unused(docs, "_own_key", "_pass_no", "_position")
    wanted = materialize(copies.groupBy(F.col("_key").alias(k), F.col("_pass").alias(n)).agg(F.min("_position").alias(at)), "positions")
    return docs.withColumn(k, row_key()).join(wanted, k).orderBy(at, k).drop(k, n, at)
