"""Every query with an oracle, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from corvane.plans import catalogue

FOLDER = os.environ.get("CORVANE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return connection


def shown(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return f"[{','.join(map(shown, value))}]"
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = oracle.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = sorted(tuple(shown(row[i]) for i in places) for row in found.fetchall())
    assert sorted(tuple(shown(row[c]) for c in columns) for row in df.collect()) == wanted


def test_every_query_without_oracle_runs(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, FOLDER).count() > 0
