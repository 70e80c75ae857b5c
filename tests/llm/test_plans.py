"""Queries of this package that have SQL, against DuckDB on the smallest tables; the others run."""

from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")

from tidemark.llm import plans  # noqa: E402


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    if name not in plans.ORACLES:
        assert got
        return
    con = pytest.importorskip("duckdb").connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    result = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in result.description]
    place = [columns.index(n) for n in names]
    assert got == sorted(repr(tuple(r[i] for i in place)) for r in result.fetchall())


def test_texts_survive_the_round_trip(spark):
    assert plans.p6_roundtrip(spark, str(FOLDER)).where("not same").count() == 0


def test_documents_of_many_files(spark, tmp_path):
    """A table with as many splits as there are cores stays where it is; the result is that of one that is spread."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    few, many = plans._documents(spark, str(FOLDER)), plans._documents(spark, str(tmp_path))
    assert "Exchange" in few._jdf.queryExecution().toString() and "Exchange" not in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, plans.p6_ids(spark, str(tmp_path)).collect())) == sorted(map(tuple, plans.p6_ids(spark, str(FOLDER)).collect()))


def test_named_queries_are_registered():
    import __spark_entry__ as entry

    assert {"p1_found", "p4_found", "p6_ids", "p7_packing", "p8_found"} <= set(entry.queries())
