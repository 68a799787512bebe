"""Every registered query with SQL gives the rows DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from compare import TABLES, _near, sorted_rows
from seqloom.plans import registry

SF = "/root/testdata/sf0.001"
#: One query of each kind here; compare.py runs all of them.
NAMES = ["STR-11", "KMR-1", "KMR-8", "SIM-1", "JON-6", "ENR-9", "CLU-2", "CLU-9", "RED-6", "SPL-1", "SPL-5", "SPL-22", "PRP-9", "PRP-14", "NEG-14", "MET-4", "SRC-13", "STR-18"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(registry.SQL[name])
    want = sorted_rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) and all(map(_near, got[1], want[1]))


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
