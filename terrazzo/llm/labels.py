"""Labelled rows for the classifiers: which rows may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.llm.common import materialize, text_or_empty


def crc_mod(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus`` (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out remainder, the first by a hash of their ids.

    The sample is bounded, so it is broadcast to the documents, which are not shuffled.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(modulus) != held))
    usable = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = materialize(usable.orderBy(F.xxhash64("_id"), "_id").limit(rows), "label-sample")
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
