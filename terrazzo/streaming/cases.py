"""Case files as a stream: each new file's pairs are parsed and related as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from terrazzo.functions.geometry import st_geomfromjson
from terrazzo.operators.relate import predicates


def stream_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, family, a, b) of the JSON lines in files that appear in ``folder``."""
    lines = spark.readStream.text(folder).where(F.trim("value") != "")
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(field("id").alias("pair"), field("family").alias("family"), st_geomfromjson(field("a")).alias("a"), st_geomfromjson(field("b")).alias("b"))


def relate_stream(cases: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the predicates of each batch of pairs as Parquet under ``out``/batch=<n>; a batch run again replaces its own."""

    def batch(df: DataFrame, n: int) -> None:
        predicates(df.select("pair", "a", "b")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return cases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
