"""Every query of the core that has SQL, against DuckDB on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")

from tidemark.plans import files, general, store, streams  # noqa: E402

QUERIES = {**store.QUERIES, **files.QUERIES, **general.QUERIES, **streams.QUERIES}
ORACLES = {**store.ORACLES, **files.ORACLES, **general.ORACLES, **streams.ORACLES}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*names).collect())
    if name not in ORACLES:
        pytest.skip("no SQL")
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    place = [columns.index(n) for n in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in result.fetchall())


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
