"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from lakeloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, DATA)
    want = sql.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_works_without_the_training_data_operators(tmp_path):
    """A copy without the llm folders and the pipeline imports, and offers the other queries."""
    import shutil

    shutil.copytree(f"{ROOT}/lakeloom", tmp_path / "lakeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=60)
