"""The driver's contract: every query runs on the smallest tables and agrees with its SQL twin."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SMALL = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import parity  # noqa: E402

from detlake.plans import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, str(SMALL))
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert sorted(tuple(parity.plain(r[c]) for c in order) for r in rows) == sorted(tuple(parity.plain(r[names.index(c)]) for c in order) for r in theirs)
