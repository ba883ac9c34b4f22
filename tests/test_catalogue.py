"""Registered queries against the SQL that states them, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fieldglass.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.ndim == 0 else str(v)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", [n for n in queries.SQL])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(queries.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert queries.entry(spark, SF).count() == 4 and set(queries.QUERIES) <= set(__spark_entry__.queries())
