"""Every feed-engine query with SQL gives the oracle's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from newsdesk.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda d: sorted(tuple("" if pd.isna(v) else str(v) if not isinstance(v, float) else f"{v:.9g}" for v in row) for row in d[columns].astype(object).itertuples(index=False))
    same = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]
    assert same(plain(got)) == same(plain(want))
