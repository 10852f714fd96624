"""Every engine query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from archipelago import catalog, oracle

DATA = "/root/testdata/sf0.001"


def rows(frame):
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    names = sorted(frame.columns)
    return sorted(str(tuple(plain(v) for v in r)) for r in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{DATA}/part.parquet'")
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
