import random

from conftest import rows

from tidemark.llm import topn


def brute(data, n):
    out = []
    for g in {r[0] for r in data if r[0] is not None}:
        items = sorted({(s, -1 if i is None else i) for k, s, i in data if k == g and s is not None}, reverse=True)[:n]
        out += [(g, s, None if i == -1 else i) for s, i in items]
    return sorted(out, key=repr)


def test_against_brute_force_with_a_hot_group_and_small_batches(spark):
    rnd = random.Random(1)
    data = [(b"hot" if rnd.random() < 0.4 else rnd.choice([b"a", b"", None, b"k%d" % rnd.randrange(50)]), rnd.choice([None, rnd.randrange(12), rnd.randrange(500)]), rnd.choice([None, rnd.randrange(9)])) for _ in range(3000)]
    data += data[:400]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "k binary, v long, s long, g string, i int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for n in (1, 3):
            assert rows(topn.top_n(df, "k", "v", "s", n)) == brute(data, n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([(b"a", 1, 1), (b"a", 1, 2), (b"a", 1, 2), (b"a", 0, 9), (b"b", None, 1)], "k binary, v long, s long")
    assert rows(topn.top_n(df, "k", "v", "s", 2)) == [(b"a", 1, 1), (b"a", 1, 2)]
    assert rows(topn.top_n(df.limit(0), "k", "v", "s", 2)) == []


def test_the_shuffle_gets_n_rows_of_a_group_from_a_partition(spark):
    df = spark.range(0, 10_000, 1, 4).selectExpr("cast('k' as binary) as k", "id as v", "id as s")
    plan = topn.top_n(df, "k", "v", "s", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")
