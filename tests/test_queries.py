"""Every registered query of the engine against its SQL, and the entry module."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as found:
        for name in TABLES:
            found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        yield found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    rows, columns = [tuple(r) for r in got.collect()], got.columns
    if name not in ORACLES:
        assert rows
        return
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(columns)
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
