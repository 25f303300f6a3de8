"""Shared pieces of the corpus operators: shared storage, word splitting, skew-safe lookups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.session import materialize, shared_dir  # noqa: F401

#: The white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = f"[^{SPACE_CLASS}]+"

#: Salts that one key is dealt over; a key holding a third of all rows stays below 1 % of them a task.
SALTS = 64


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts))


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, salt_by: str, salts: int = SALTS) -> DataFrame:
    """``left`` join ``right`` (one row a key) on ``key``, without a hot key meeting in one task.

    Every left row gets a salt from ``salt_by``. The distinct (key, salt) pairs, which map tasks
    combine before they are shuffled, fetch the right-hand columns, and the rows then join on both.
    A null key matches a null key.
    """
    salted = left.withColumn("_salt", salt_of(salt_by, salts=salts))
    pairs = salted.select(key, "_salt").distinct()
    r = right.withColumnRenamed(key, "_rkey")
    fetched = pairs.join(r, F.col(key).eqNullSafe(F.col("_rkey"))).drop("_rkey")
    f = fetched.withColumnRenamed(key, "_fkey").withColumnRenamed("_salt", "_fsalt")
    return salted.join(f, F.col(key).eqNullSafe(F.col("_fkey")) & (F.col("_salt") == F.col("_fsalt"))).drop("_fkey", "_fsalt", "_salt")


def bucketed(df: DataFrame, key: str, files: int, name: str) -> DataFrame:
    """``df`` written once to the shared folder as a table bucketed by ``key``: joins on the key don't move its rows, nor does writing it: each task
    writes a file for every bucket that it has rows of."""
    spark, table = df.sparkSession, f"terrazzo_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/terrazzo-tables/{name}-{table}"
    df.write.format("parquet").bucketBy(files, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text (a longer text comes alone)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def filled(column: pa.Array) -> pa.Array:
    """The text column as plain strings, nulls as empty strings, offsets from zero."""
    return pa.concat_arrays([pa.compute.fill_null(column.cast(pa.string()), "")])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores set before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
