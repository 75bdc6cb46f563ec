import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings job_records raw_ingested_jobs job_ingestion_runs extracted_intelligence job_sources fx_rates canonical_values golden_items context_windows".split()


def canonical(df):
    def f(x):
        if isinstance(x, float):
            return "NULL" if math.isnan(x) else repr(round(x, 6) + 0.0)
        try:
            return "NULL" if x is None or pd.isna(x) else str(x)
        except ValueError:
            return str(x)

    return sorted(tuple(f(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, duck, name):
    mine = entry.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)
