"""The queries that have SQL against DuckDB."""

import duckdb
import pytest

from curvelens.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(catalogue.oracle_sql()[name])
    own = [x[0] for x in result.description]
    assert sorted(own) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[own.index(c)]) for c in columns) for r in result.fetchall())
