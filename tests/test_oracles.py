"""Every registered query of the library against its DuckDB SQL."""

from __future__ import annotations

import duckdb
import pytest

from evidentia.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    names = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    assert ours == sorted((tuple(r[theirs.index(c)] for c in names) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
