"""Case files: JSON lines of geometry pairs, manifests with checksums, selective scans."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrazzo.functions.geometry import st_asjson, st_geomfromjson

CASE = "id string, family string, tags string, a string, b string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(pair, family, tags, a, b) of JSON lines; blank lines are skipped, geometries are typed JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(field("id").alias("pair"), field("family").alias("family"), field("tags").alias("tags"), st_geomfromjson(field("a")).alias("a"), st_geomfromjson(field("b")).alias("b"))


def case_lines(cases: DataFrame) -> DataFrame:
    """One JSON text per case (pair, family, a, b), keys in a fixed order."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    bare = lambda c: F.regexp_extract(quoted(c), r'^\{"v":(.*)\}$', 1)
    parts = [F.concat(F.lit('"id":'), bare("pair")), F.concat(F.lit('"family":'), bare("family")), F.concat(F.lit('"a":'), st_asjson("a")), F.concat(F.lit('"b":'), st_asjson("b"))]
    return cases.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def write_cases(cases: DataFrame, path: str) -> None:
    case_lines(cases).write.text(path)


def digests(cases: DataFrame) -> DataFrame:
    """(pair, sha256) of each case's canonical line."""
    return case_lines(cases).select(F.get_json_object("value", "$.id").alias("pair"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))


def scan_ids(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines (value) whose id is wanted: the id is cut out by pattern before anything is parsed; one line of each id stays.

    That is the first by ``at`` where the lines have it (``read_lines`` adds it), else the least text.
    """
    rows = lines.withColumn("id", F.regexp_extract("value", r'"id"\s*:\s*"([^"]+)"', 1))
    order = F.col("at") if "at" in lines.columns else F.col("value")
    return rows.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("value", order).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines of text files and their place, by file name and block, then in the order read."""
    rows = spark.read.text(path)
    return rows.select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def manifest_problems(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Files missing, not listed or changed."""
    f, m = found.select("path", F.col("sha256").alias("f")), listed.select("path", F.col("sha256").alias("m"))
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "not listed").when(F.col("f") != F.col("m"), "changed")
    return f.join(m, "path", "full").withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")


def read_toml(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The entries of one array of tables in TOML files (small, written by hand)."""
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    names = [part.strip().split()[0] for part in schema.split(",")]
    rows = [tuple(entry.get(n) for n in names) for text in texts for entry in tomllib.loads(text).get(table, [])]
    return spark.createDataFrame(rows, schema)
