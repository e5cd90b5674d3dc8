"""Every query with oracle SQL gives DuckDB's rows on a small table."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from actlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, db, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    cursor = db.execute(catalog.oracle_sql()[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_report(spark):
    assert catalog.queries()["align_report"](spark, SF).count() > 0
