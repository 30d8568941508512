"""Every registered query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from tideloom.plans.catalogue import ORACLE_SQL, QUERIES

KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


#: Generate every series of a profile; the same code runs on some classes below.
WHOLE_PROFILES = {"profile_full", "profile_stationary1000"}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - WHOLE_PROFILES))
def test_same_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    rel = duck.execute(ORACLE_SQL[name])
    kinds = {c[0]: str(c[1]) for c in rel.description}
    theirs = rel.fetchall()
    at = [list(kinds).index(c) for c in columns]
    assert {c: KIND[k] for c, k in df.dtypes} == kinds
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in theirs)


@pytest.mark.parametrize("profile", ["full", "stationary1000"])
def test_profiles(spark, duck, profile):
    from tideloom.plans.surveyed import breaches

    assert WHOLE_PROFILES <= set(QUERIES)
    classes = ["A", "C", "H"]
    ours = {tuple(r) for r in breaches(spark, profile, classes).collect()}
    assert ours == {r for r in duck.execute(ORACLE_SQL[f"profile_{profile}"]).fetchall() if r[0] in classes}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
