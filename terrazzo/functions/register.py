"""Names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terrazzo.functions import exact, geometry
from terrazzo.operators import model
from terrazzo.session import ship

FUNCTIONS = {
    "st_parse_wkt": geometry.st_parse_wkt, "st_parse_json": geometry.st_parse_json, "st_parse_wkb": geometry.st_parse_wkb, "st_astext": geometry.st_astext, "st_asjson": geometry.st_asjson,
    "st_asbinary": geometry.st_asbinary, "exact_rational": exact.to_rational, "rational_to_double": exact.rational_to_double, "rational": exact.rational, "rational_scaled": exact.scaled,
    "ulp": exact.ulp, "nudge": exact.nudge, "double_text": exact.double_text, "valuation": model.valuation, "sqrt_sum": exact.sqrt_sum,
}


def register(spark: SparkSession) -> SparkSession:
    """Register the scalar functions, so that SQL can call them by name."""
    ship(spark)
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return spark
