import random

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import mvcc, scan
from tidemark.sources.log import entries

LOG = "user_key binary, version long, seq long, value binary, meta int, expires_at long"


def log(spark, data):
    return spark.createDataFrame(data, LOG)


def test_visibility(spark):
    data = [
        (b"empty", 1, 1, b"", 0, 0),
        (b"gone", 1, 2, b"x", 0, 0),
        (b"gone", 2, 3, b"", 1, 0),
        (b"old", 1, 4, b"x", 0, 100),
        (b"later", 1, 5, b"x", 0, 101),
        (b"same", 1, 6, b"first", 0, 0),
        (b"same", 1, 7, b"last", 0, 0),
    ]
    got = {bytes(r.user_key): bytes(r.value) for r in mvcc.snapshot(log(spark, data), 100).collect()}
    assert got == {b"empty": b"", b"later": b"x", b"same": b"last"}
    assert mvcc.get(log(spark, data), b"gone", 100, 1).first().version == 1
    assert mvcc.get(log(spark, data), b"gone", 100).first() is None


def test_reads_of_nothing(spark):
    none = log(spark, [])
    assert rows(mvcc.snapshot(none, 1)) == [] and rows(mvcc.read_version(none)) == [(0,)]
    assert rows(scan.ends(none)) == [(None, None, None, None)] and rows(scan.seek(none, b"a", 1)) == []
    probes = spark.createDataFrame([(1, b"a", 5)], "probe long, user_key binary, version long")
    assert rows(scan.seek_many(probes, none)) == [(1, None, None)] and rows(mvcc.as_of(probes, none)) == [(1, b"a", None)]


def test_multi_get_statuses(spark):
    data = [(b"a", 1, 1, b"v", 0, 0), (b"b", 1, 2, b"v", 1, 0), (b"c", 1, 3, b"v", 0, 5)]
    keys = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (b"c",), (b"d",), (None,), (b"",)], "user_key binary")
    assert rows(mvcc.multi_get(log(spark, data), keys, 9)) == [(b"a", "found", 1, b"v"), (b"b", "deleted", 1, None), (b"c", "expired", 1, None), (b"d", "absent", None, None)]


def test_overlay(spark):
    data = [(b"a", 1, 1, b"old", 0, 0), (b"b", 1, 2, b"old", 0, 0), (b"c", 9, 3, b"new", 0, 0)]
    own = spark.createDataFrame([(b"a", b"own", 0, 0), (b"b", b"", 1, 0), (b"d", b"own", 0, 3)], "user_key binary, value binary, meta int, expires_at long")
    assert rows(mvcc.overlay(log(spark, data), own, 3, 5)) == [(b"a", 5, b"own")]


def test_as_of_against_brute_force(spark):
    rnd = random.Random(2)
    places = [(rnd.choice([b"a", b"b"]), rnd.randrange(100_000)) for _ in range(300)]
    probes = [(i, rnd.choice([b"a", b"b", b"c"]), rnd.randrange(120_000)) for i in range(200)]
    got = {r[0]: r[2] for r in rows(mvcc.as_of(spark.createDataFrame(probes, "probe long, user_key binary, version long"), spark.createDataFrame(places, "user_key binary, version long")))}
    assert got == {i: max((v for k2, v in places if k2 == k and v <= t), default=None) for i, k, t in probes}


def test_retention_and_discarded_versions(spark):
    data = [(b"a", v, v, b"", 4 if v == 3 else 0, 1 if v == 4 else 0) for v in range(1, 6)]
    assert [r[1] for r in rows(mvcc.retained(log(spark, data), 2, 9))] == [5]
    assert [r[1] for r in rows(mvcc.without_discarded(log(spark, data)))] == [3, 4, 5]
    assert rows(mvcc.merged(log(spark, data), {"n": F.count("*")}, 9)) == [(b"a", 4)]


def test_entries_take_each_write_once(spark):
    raw = spark.createDataFrame([(b"a", 1, None, None, None, None, 2, 9, 1, None), (b"a", 1, None, None, None, None, 1, 50, 1, None), (None, 1, None, 0, 0, 0, 1, 1, 2, None), (b"b", None, None, 0, 0, 0, 1, 1, 3, None)], "user_key binary, version long, value binary, meta int, user_meta int, expires_at long, fid long, log_offset long, seq long, table_id long")
    assert rows(entries(raw)) == [(b"a", 1, b"", 0, 0, 0, 1, 50, 1, None)]


def test_seeks_of_ten_thousand_keys(spark):
    keys = spark.range(10_000).select(F.concat(F.lit(b"k"), F.encode(F.lpad(F.col("id").cast("string"), 4, "0"), "UTF-8")).alias("user_key"), F.lit(0).cast("long").alias("version"))
    # Probe, first at or behind it, last at or before it.
    known = [("abc", "k0000", None), ("k0100", "k0100", "k0100"), ("k0100b", "k0101", "k0100"), ("k1234", "k1234", "k1234"), ("k1234b", "k1235", "k1234"), ("k9999", "k9999", "k9999"), ("z", None, "k9999")]
    probes = spark.createDataFrame([(i, p.encode(), 0) for i, (p, _, _) in enumerate(known)], "probe long, user_key binary, version long")
    ge = {r[0]: r[1] for r in rows(scan.seek_many(probes, keys))}
    le = {r[0]: r[1] for r in rows(scan.seek_many_for_prev(probes, keys))}
    for i, (p, up, down) in enumerate(known):
        assert ge[i] == (up and up.encode()) and le[i] == (down and down.encode())
        one, back = scan.seek(keys, p.encode(), 0).first(), scan.seek_for_prev(keys, p.encode(), 0).first()
        assert (one and bytes(one[0])) == ge[i] and (back and bytes(back[0])) == le[i]


def test_batched_seeks_against_single_ones(spark):
    rnd = random.Random(4)
    places = list({(bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 4))), rnd.randrange(20)) for _ in range(120)} | {(b"hot", v) for v in range(200)})
    log_df = spark.createDataFrame(places, "user_key binary, version long")
    probes = [(i, rnd.choice([b"a", b"bb", b"hot", b"zz", b"cab"]), rnd.randrange(-1, 210)) for i in range(80)]
    df = spark.createDataFrame(probes, "probe long, user_key binary, version long")
    order = sorted(places, key=lambda p: (p[0], -p[1]))
    ge, le = {r[0]: r[1:] for r in rows(scan.seek_many(df, log_df))}, {r[0]: r[1:] for r in rows(scan.seek_many_for_prev(df, log_df))}
    for i, k, v in probes:
        assert ge[i] == next((p for p in order if (p[0], -p[1]) >= (k, -v)), (None, None))
        assert le[i] == next((p for p in reversed(order) if (p[0], -p[1]) <= (k, -v)), (None, None))


def test_scans(spark):
    df = spark.createDataFrame([(b"a", 1), (b"a", 2), (b"ab", 1), (b"b", 1), (b"\xff", 1)], "user_key binary, version long")
    assert [tuple(r) for r in scan.scan(df).collect()][:2] == [(b"a", 2), (b"a", 1)]
    assert [r[0] for r in scan.prefix_scan(df, b"a").collect()] == [b"a", b"a", b"ab"]
    assert [r[0] for r in scan.prefix_scan(df, b"\xff").collect()] == [b"\xff"] and scan.prefix_end(b"\xff") is None
    assert [tuple(r) for r in scan.last_entries(df, 2).collect()] == [(b"\xff", 1), (b"b", 1)]
    assert [r[0] for r in scan.scan(df, b"ab", b"b").collect()] == [b"ab"]


def test_hot_keys_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select(F.encode((F.col("id") % 3).cast("string"), "UTF-8").alias("user_key"), F.col("id").alias("version"), F.col("id").alias("seq"))
    plan = mvcc.newest(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_merges_in_order(spark):
    """A fold that isn't commutative, over more writes of a key than are folded at once."""
    from tidemark.operators import mvcc

    rnd = random.Random(9)
    data = [(b"hot" if rnd.random() < 0.6 else b"k%d" % rnd.randrange(5), rnd.randrange(300), i, b"%d," % i, rnd.choice([0, 0, 0, 1]), rnd.choice([0, 0, 50])) for i in range(3000)]
    log = spark.createDataFrame(data, "user_key binary, version long, seq long, value binary, meta int, expires_at long").repartition(5)
    want = {}
    for k, _, _, x, m, e in sorted(data, key=lambda r: r[1:3]):
        if not m and (not e or e > 100):
            want[k] = want.get(k, b"") + x
    kept, mvcc.FOLDED = mvcc.FOLDED, 7
    try:
        for spans in (1, 16):
            assert {r[0]: r[1] for r in rows(mvcc.merged_in_order(log, F.col("value"), F.concat, 100, spans))} == want
    finally:
        mvcc.FOLDED = kept
    assert rows(mvcc.merged_in_order(log.limit(0), F.col("value"), F.concat, 100)) == []
