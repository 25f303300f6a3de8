"""Importance resampling towards a target: a dictionary of distinct features.

Features are runs of 1 to ``longest`` words. All occurrences are counted by string over whole tables, those of the
documents and of the target side by side; each distinct string is hashed once, and buckets add its
counts up. A bucket's gain compares its share in the target with its share in the documents. Gains are
joined back to the distinct strings and from there to the feature counts of each document, whose weighted
sum, with noise from a digest of its doc_id, is its score. The highest scores are drawn.

Features that many documents hold are few: the gains of the ``COMMON`` most frequent ones at most, each of at most
``SHORT`` bytes, are sent to the tasks, whatever the input; all others reach their documents by a join on the
feature, salted by row. Ranks come from sorted ranges, each counting its own.

Defined results: a null text has no words; texts without features weigh 0 and are never drawn; a null
doc_id draws its noise from the digest of the empty id and loses ties; rows repeated with their doc_id are
scored and ranked each; an empty table gives an empty result, an empty target counts 0 features; long texts
are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrazzo.llm.common import filled, materialize, skew_safe_lookup, slices
from terrazzo.llm.words import split_arrays, sums

BUCKETS = 10_000
SEED = "2024"
#: Share drawn, in 100, of the documents with at least MIN_WORDS words.
SHARE, MIN_WORDS = 10, 20
#: Features whose gains the tasks know at most, and the bytes of such a feature.
COMMON, SHORT = 1 << 16, 64
#: The size of a count, in 64ths of a power of two.
_GRADE = "floor(log2(s + t) * 64)"

#: Letters and digits, those from A to Z in lower case, and all bytes beyond ASCII; others separate words.
_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
_BYTES[0x61:0x7B] = _BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTES[0x80:] = np.arange(0x80, 0x100)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, all words one after the other) of plain strings."""
    _, ends, data = texts.buffers()
    plain = _BYTES[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return split_arrays(pa.Array.from_buffers(pa.string(), len(texts), [None, ends, pa.py_buffer(plain)]))


def features(texts: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, owners, codes, distinct): the runs of 1 to ``longest`` words of all texts, each the code of a distinct string."""
    offsets, one = words(texts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    owners, runs = [owner], [one]
    for size in range(2, longest + 1):
        n = max(0, len(one) - size + 1)
        inside = owner[:n] == owner[len(owner) - n :]
        joined = reduce(lambda a, b: pc.binary_join_element_wise(a, b, " "), [one.slice(k, n) for k in range(size)])
        owners.append(owner[:n][inside])
        runs.append(joined.filter(pa.array(inside)))
    coded = pa.concat_arrays(runs).dictionary_encode()
    return np.diff(offsets), np.concatenate(owners), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def feature_counts(docs: DataFrame, longest: int) -> DataFrame:
    """(feature, n): occurrences by task; to be added up."""

    def run(batches):
        for part in slices(batches, "text"):
            _, _, codes, distinct = features(filled(part.column("text")), longest)
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)))], ["feature", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature string, n bigint")


def dictionary(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct feature: feature, s and t (occurrences in documents and target), bucket, gain of the bucket."""
    none = F.lit(0).cast("bigint")
    both = feature_counts(docs, longest).select("feature", F.col("n").alias("s"), none.alias("t"))
    both = both.unionByName(feature_counts(target, longest).select("feature", none.alias("s"), F.col("n").alias("t")))
    distinct = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    distinct = materialize(distinct.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets), "features")
    held = distinct.groupBy("bucket").agg(F.sum("s").alias("_s"), F.sum("t").alias("_t"))
    total = held.agg(F.sum("_s").alias("s"), F.sum("_t").alias("t")).first()
    real = lambda c: F.col(c).cast("double")
    whole = lambda n: F.lit(float((n or 0) + buckets))
    gain = F.floor(1000 * F.log((real("_t") + 1) * whole(total["s"]) / ((real("_s") + 1) * whole(total["t"]))))
    return distinct.join(F.broadcast(held.select("bucket", gain.cast("bigint").alias("gain"))), "bucket")  # one row a bucket


def common_gains(known: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """(features, gains) of the most frequent short features, at most COMMON."""
    short = known.where(F.octet_length("feature") <= SHORT)
    grades = short.groupBy(F.expr(_GRADE).alias("grade")).agg(F.count(F.lit(1)).alias("k")).collect()  # a few thousand at most
    held, bound = 0, None
    for grade, k in sorted(((r.grade, r.k) for r in grades), reverse=True):
        if held + k > COMMON:
            break
        held, bound = held + k, grade
    often = short.where(F.lit(False) if bound is None else F.expr(_GRADE) >= bound).select("feature", "gain").toArrow()
    return pa.concat_arrays(often["feature"].chunks) if often.num_rows else pa.array([], pa.string()), often["gain"].to_numpy()


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from a digest of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def importance(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score."""
    known = materialize(dictionary(docs, target, longest, buckets).select("feature", "s", "t", "gain"), "feature-gains")
    sent = docs.sparkSession.sparkContext.broadcast(common_gains(known))

    def run(batches):
        common, gains = sent.value
        for part in slices(batches, "text"):
            n_words, owners, codes, distinct = features(filled(part.column("text")), longest)
            at = pc.index_in(distinct, value_set=common).fill_null(-1).to_numpy(zero_copy_only=False)[codes]
            here = at >= 0
            weight = np.zeros(len(n_words), np.int64)
            np.add.at(weight, owners[here], gains[at[here]])
            # the other features of each document, with their counts
            pairs, n = np.unique(owners[~here] * max(1, len(distinct)) + codes[~here], return_counts=True)
            owner, code = np.divmod(pairs, max(1, len(distinct)))
            rest = pa.StructArray.from_arrays([distinct.take(pa.array(code)), pa.array(n)], ["feature", "n"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(n_words) + 1)).astype(np.int32)), rest)
            columns = part.column("doc_id"), pa.array(n_words), pa.array(np.bincount(owners, minlength=len(n_words))), pa.array(weight), rest
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_words", "n_features", "weight", "rest"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, rest array<struct<feature:string,n:bigint>>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "feature-weights")
    rest = rows.select("row", F.explode("rest").alias("f")).select("row", "f.feature", "f.n")
    more = skew_safe_lookup(rest, known.select("feature", "gain"), "feature", "row").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    out = rows.drop("rest").join(more, "row", "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "row")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Of the N documents with ``min_words`` or more, the floor(share N / 100) highest scores are drawn, ties to the smaller doc_id.
    """
    scored = materialize(importance(docs, target, longest, buckets, seed), "scores")
    able = F.col("n_words") >= min_words
    drawn = share * scored.where(able).count() // 100
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    parts = materialize(scored.where(able).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "score-ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range: as many as shuffle partitions
    before = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    ranked = parts.join(F.broadcast(before), "_part").withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_part", "_before")
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))).drop("row")
