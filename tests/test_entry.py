"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from terrazzo.plans import queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(columns, values):
    norm = lambda v: float(v) if isinstance(v, float) else v
    return sorted(repr([norm(r[c]) for c in sorted(columns)]) for r in values)


@needs_data
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE_SQL and n not in queries.ALIASES])
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    out = db.sql(queries.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(df.columns)
    assert rows(df.columns, [r.asDict() for r in df.collect()]) == rows(out.columns, [dict(zip(out.columns, v)) for v in out.fetchall()])


@needs_data
def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
