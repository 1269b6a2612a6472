"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canon(row):
    return tuple("" if x is None else f"{x + 0.0:.6f}" if isinstance(x, float) and not math.isnan(x) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(canon(r) for r in df.select(*columns).collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in columns]
    want = sorted(canon([r[i] for i in at]) for r in found.fetchall())
    assert len(names) == len(columns) and got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
