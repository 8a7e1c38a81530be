"""Every query of the temporal operators against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(r[i] for i in order) for r in data) if all(v is not None for r in data for v in r) else sorted((tuple(r[i] for i in order) for r in data), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = rows(columns, want.fetchall())
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert expected, "no rows to compare"
    if any(isinstance(v, float) for v in expected[0]):
        assert [tuple(round(v, 2) if isinstance(v, float) else v for v in r) for r in found] == [tuple(round(v, 2) if isinstance(v, float) else v for v in r) for r in expected]
    else:
        assert found == expected
