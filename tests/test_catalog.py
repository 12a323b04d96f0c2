import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillveil.plans import registered as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (np.ndarray, list, tuple)):
            return str([x.item() if isinstance(x, np.generic) else x for x in v])
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.integer)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
