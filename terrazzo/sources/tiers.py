"""Tiers of cases, expected answers, score sets and a store of answers, as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ANSWER = "sha256 string, version string, answer string"


def read_tier(spark: SparkSession, root: str, tier: str) -> DataFrame:
    """Lines (value, family) of one tier under ``root``/tier=.../family=...; only its folders are read. An unknown tier is an error."""
    rows = spark.read.option("basePath", root).text(f"{root}/tier=*")
    known = rows.select("tier").distinct()
    if known.where(F.col("tier") == tier).isEmpty():
        raise ValueError(f"no tier {tier!r} under {root}")
    return rows.where(F.col("tier") == tier).drop("tier")


def read_expected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Expected answers of JSON lines, one row an id; lines that are no JSON go."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull() & F.col("id").isNotNull()).drop("_corrupt")


def read_scores(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Score records of all files ``root``/<target>/<tier>.score.jsonl, with the target and tier of their path."""
    rows = spark.read.schema(schema).json(f"{root}/*/*.score.jsonl").withColumn("_path", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("_path", r"([^/]+)/([^/]+)\.score\.jsonl$", i)
    return rows.withColumn("target", part(1)).withColumn("tier", part(2)).drop("_path")


def stored(spark: SparkSession, path: str, wanted: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Answers in the store for ``wanted`` (sha256) under a version, and the digests that it lacks."""
    try:
        rows = spark.read.schema(ANSWER).parquet(path)
    except Exception as missing:  # a store that nobody has written to
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], ANSWER)
    rows = rows.where(F.col("version") == version).groupBy("sha256").agg(F.min("answer").alias("answer"))
    keys = wanted.select("sha256").distinct()
    return rows.join(keys, "sha256", "left_semi"), keys.join(rows, "sha256", "left_anti")


def store(answers: DataFrame, path: str, version: str) -> None:
    """Append answers (sha256, answer) of a version to the store."""
    answers.select("sha256", F.lit(version).alias("version"), "answer").write.mode("append").parquet(path)
