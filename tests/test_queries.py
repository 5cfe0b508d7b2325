"""Every registered query of the engine against DuckDB on the same small tables."""

import os

import duckdb
import pytest

from loomrank.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(frame, columns):
    def one(x):
        if x is None or x != x:
            return ""
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_matches_duckdb(spark, db, name):
    got, want = engine.QUERIES[name](spark, DATA).toPandas(), db.execute(engine.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for c in columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert shown(got, columns) == shown(want, columns)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, DATA).count() > 0
