"""Every query with SQL gives what DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from lectern.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    answer = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
