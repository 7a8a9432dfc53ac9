"""Every query with SQL gives the SQL's rows; every other one gives rows."""

import glob
import math
import os

import duckdb
import pytest

from tidewatch import plans, registry

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    r = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())


@pytest.mark.parametrize("name", ["features_51", "ews_null_control", "logistic_fit", "curation_gates", "simulated_benchmark", "t_mixture", "out_of_distribution"])
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
