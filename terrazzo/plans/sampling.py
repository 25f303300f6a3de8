"""Corpus sampling: strata, largest-remainder quotas, first occurrences, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hash_rank(rows: DataFrame, stratum: str, key: str = "id") -> DataFrame:
    """``rank`` of each row in its stratum by the SHA-256 of its key."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string").cast("binary"), 256), key)
    return rows.withColumn("rank", F.row_number().over(w))


def quotas(sizes: DataFrame, total: int) -> DataFrame:
    """(stratum, n, quota): ``total`` split in proportion to n by largest remainders; ties go to the lesser stratum.

    One row a stratum; the window over all strata sorts as many rows as there are strata.
    """
    rows = sizes.withColumn("all", F.sum("n").over(Window.partitionBy()))
    share = F.col("n").cast("decimal(38,0)") * total
    rows = rows.withColumn("_base", F.expr(f"n * {total} DIV all")).withColumn("_rest", share % F.col("all"))
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), "stratum"))
    return rows.withColumn("_left", F.least(left, F.lit(total))).withColumn("_rank", rank).select("stratum", "n", F.least(F.col("n"), F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("bigint")).alias("quota"))


def stratified_sample(rows: DataFrame, stratum: str, total: int, key: str = "id") -> DataFrame:
    """``total`` rows (or all, if fewer), each stratum by its quota, chosen by hash rank."""
    sizes = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    q = quotas(sizes, total).select(F.col("stratum").alias(stratum), "quota")
    return hash_rank(rows, stratum, key).join(q, stratum).where("rank <= quota").drop("rank", "quota")


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the answer cache does not hold."""
    return wanted.join(cache.select(*keys), keys, "left_anti")
