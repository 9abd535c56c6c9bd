"""Every query of the sequence engine against its SQL on the smallest tables."""

import duckdb
import pytest

from plectra.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def plain(rows):
    return sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*columns).collect()) == plain(want.project(quoted).fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
