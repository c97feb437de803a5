"""Every query of the operators that has SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from lakeloom.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(value):
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return tuple(value.values()) if isinstance(value, dict) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in (r.asDict(recursive=True) for r in got.collect()))
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
