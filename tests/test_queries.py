"""Every query against its SQL, and the entry query."""

import math

import duckdb
import pytest

import __spark_entry__
from curvelens.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    own = [x[0] for x in result.description]
    assert sorted(own) == columns
    assert got == sorted(tuple(shown(r[own.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
