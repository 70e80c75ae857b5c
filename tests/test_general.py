import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import changes, heavy, incremental

FEED = "key binary, version long, meta binary, seq long, stream_id long, arrived_at timestamp_ntz, _salt int, n string"
T0 = dt.datetime(2025, 6, 1)


def feed(spark, data):
    """Changes with columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x") for r in data], FEED)


def random_feed(rnd, n, hot=0.35):
    out = []
    for seq in range(n):
        key = b"hot" if rnd.random() < hot else rnd.choice([b"a", b"b", b"\xc3\xa9", b"", None, b"k%d" % rnd.randrange(40)])
        version = rnd.choice([None, *[rnd.randrange(200)] * 9])
        row = (key, version, rnd.choice([b"\x00", b"\x01", b"\x41", b"", None]), seq, rnd.randrange(3), T0 + dt.timedelta(minutes=rnd.randrange(100)))
        out += [row] * rnd.choice([1, 1, 1, 2])
        if rnd.random() < 0.1:
            out.append((*row[:4], rnd.randrange(3), T0 + dt.timedelta(minutes=rnd.randrange(100))))
    rnd.shuffle(out)
    return out


def test_state_against_brute_force(spark):
    data = random_feed(random.Random(1), 900)
    last = {}
    for k, v, m, s, *_ in data:
        if k and v is not None and (k not in last or (v, s) > last[k][:2]):
            last[k] = (v, s, bool(m) and m[0] & 1)
    want = sorted((("kv", k.decode(), s) for k, (v, s, gone) in last.items() if not gone), key=repr)
    assert rows(changes.kv_state(feed(spark, data))) == want
    assert rows(changes.kv_state(feed(spark, data), salts=1)) == want
    assert rows(changes.kv_state(feed(spark, []))) == []


def test_a_change_with_very_many_copies(spark):
    data = [(b"a", 5, b"", 1, 0, T0)] * 3000 + [(b"a", 4, b"\x01", 2, 0, T0), (b"b", 1, b"\x01", 3, 0, T0)] * 2
    df = feed(spark, data).repartition(6)
    assert rows(changes.kv_state(df)) == [("kv", "a", 1)]
    assert rows(heavy.longest_step(df)) == [(b"a", 4, 5)]
    runs = spark.createDataFrame([(1, 0, 4, 9, T0, "succeeded", T0)], "run_id long, stream_id long, since_version long, upto_version long, read_at timestamp_ntz, status string, reported_at timestamp_ntz")
    assert rows(incremental.unprocessed(df, runs)) == [(2,), (3,)]


def test_state_over_a_base(spark):
    base = spark.createDataFrame([(b"a", 5, 50), (b"b", 5, 51), (b"c", 5, 52)], "key binary, version long, seq long")
    new = spark.createDataFrame([(b"a", 4, 60, False), (b"b", 6, 61, True), (b"d", 1, 62, None)], "key binary, version long, seq long, gone boolean")
    got = changes.apply_changes(new, ["key"], F.col("version"), F.col("seq"), F.col("gone"), base)
    assert rows(got) == [(b"a", 50), (b"c", 52), (b"d", 62)]


def test_tables(spark):
    data = [(1, "CREATE", 1), (2, " delete", 1), (3, "0", 2), (3, "0", 2), (5, "1", 3), (4, "Create", 3), (6, None, 2), (7, "x", 2), (8, "CREATE", None)]
    log = spark.createDataFrame(data, "seq long, op string, table_id long")
    assert rows(changes.table_state(log)) == [("table", "2", 3)] and rows(changes.table_state(log.limit(0))) == []


def test_longest_steps_against_brute_force(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([b"hot"] * 4 + [b"k%d" % rnd.randrange(30), None, b""]), rnd.choice([None, *[rnd.randrange(10**6)] * 20])) for _ in range(4000)]
    data += [(b"tie", v) for v in (1, 3, 5, 5)] + [(b"one", 7), (b"one", 7)]
    want = []
    for key in {k for k, _ in data if k}:
        v = sorted({v for k, v in data if k == key and v is not None})
        if len(v) > 1:
            step, low = max((b - a, -a) for a, b in zip(v, v[1:]))
            want.append((key, -low, -low + step))
    df = spark.createDataFrame([(*r, "x") for r in data], "key binary, version long, _bucket string")
    for shares, sampled in ((None, 400), (3, 400), (200, 10), (16, 1)):
        assert rows(heavy.longest_step(df.repartition(5), shares=shares, sampled=sampled)) == sorted(want, key=repr)
    assert rows(heavy.longest_step(df.limit(0))) == []


def test_longest_steps_of_one_version(spark):
    df = spark.createDataFrame([(b"a", 5)] * 100, "key binary, version long")
    assert rows(heavy.longest_step(df)) == []


def test_uneven_heavy_keys_are_spread(spark):
    """A key with one far version, one with most of its rows under one version, and one of little more than half a share."""
    n = 20_000
    hot = spark.range(n).select(F.encode(F.lit("far"), "UTF-8").alias("key"), F.when(F.col("id") == 0, 10**12).otherwise(F.col("id")).alias("version"))
    same = spark.range(n).select(F.encode(F.lit("same"), "UTF-8").alias("key"), F.when(F.col("id") < 9, F.col("id") * 1000).otherwise(5000).alias("version"))
    rest = spark.range(n).select(F.encode(F.concat(F.lit("k"), F.col("id") % 5000), "UTF-8").alias("key"), (F.col("id") % 977).alias("version"))
    df = hot.union(same).union(rest).repartition(16)
    shares = 30
    heavy_rows = {bytes(r.key): r.bounds for r in heavy.heavy_keys(df, "key", "version", shares).collect()}
    assert set(heavy_rows) == {b"far", b"same"} and all(8 <= len(b) <= 11 for b in heavy_rows.values())
    found = {r[0]: r[1:] for r in rows(heavy.longest_step(df, shares=shares))}
    assert found[b"far"] == (n - 1, 10**12) and found[b"same"] == (0, 1000)
    # no group of the exchange has much more than a share
    plan = heavy.longest_step(df, shares=shares)
    groups = df.join(heavy.heavy_keys(df, "key", "version", shares), "key")
    from tidemark.operators.ranges import place_in

    low, high = (place_in(F.col("bounds"), shares, lambda b, f=f: f(b, F.col("version"))) for f in ((lambda b, v: b < v), (lambda b, v: b <= v)))
    most = groups.groupBy("key", (low + F.pmod(F.hash(F.spark_partition_id()), high - low + 1)).alias("piece")).count().agg(F.max("count")).first()[0]
    assert most < 4 * 3 * n / shares and plan.count() == 5002 - rest.groupBy("key").agg(F.countDistinct("version").alias("d")).where("d < 2").count()


def test_unprocessed_against_brute_force(spark):
    rnd = random.Random(3)
    data = random_feed(rnd, 700)
    reports, runs = [], {}
    for run in range(25):
        stream, since = rnd.randrange(3), rnd.randrange(180)
        read_at, upto = T0 + dt.timedelta(minutes=rnd.randrange(100)), since + rnd.choice([0, 5, 20, 150])
        states = ["running", rnd.choice([" Succeeded", "SUCCEEDED", "failed", "succeeded"])] + (["revoked "] if rnd.random() < 0.2 else [])
        for i, s in enumerate(states):
            reports.append((run, stream, since, upto, read_at, s, T0 + dt.timedelta(hours=5 + i)))
        if states[-1].strip().lower() == "succeeded":
            runs[run] = (stream, since, upto, read_at)
    rnd.shuffle(reports)
    table = spark.createDataFrame(reports + reports[:5], "run_id long, stream_id long, since_version long, upto_version long, read_at timestamp_ntz, status string, reported_at timestamp_ntz")
    seen, all_seqs = set(), set()
    for k, v, _, s, stream, at in data:
        if k and v is not None:
            all_seqs.add(s)
            if any(stream == r[0] and r[1] < v <= r[2] and at <= r[3] for r in runs.values()):
                seen.add(s)
    df = feed(spark, data)
    assert {r[0] for r in rows(incremental.unprocessed(df, table))} == all_seqs - seen
    assert len(rows(incremental.unprocessed(df, table.limit(0)))) == len(all_seqs)
    assert rows(incremental.unprocessed(df.limit(0), table)) == []
    incremental.BROADCAST_ROWS, kept = 0, incremental.BROADCAST_ROWS
    try:
        assert {r[0] for r in rows(incremental.unprocessed(df, table))} == all_seqs - seen
    finally:
        incremental.BROADCAST_ROWS = kept


REPORTS = "run_id long, stream_id long, since_version long, upto_version long, read_at timestamp_ntz, status string, reported_at timestamp_ntz"


def unread(data, reports):
    """Brute force: the seqs of changes that no successful run has read."""
    last = {}
    for r in sorted(reports, key=lambda r: r[6]):
        last[r[0]] = r
    runs = [r for r in last.values() if r[5] == "succeeded"]
    real = [(s, v, stream, at) for k, v, _, s, stream, at in data if k and v is not None]
    return {x[0] for x in real} - {s for s, v, stream, at in real if at and any(stream == r[1] and r[2] < v <= r[3] and at <= r[4] for r in runs)}


def test_steps_of_a_ledger(spark, tmp_path):
    """Step by step, with late rows, backfills, a step that fails and a run that is revoked."""
    rnd = random.Random(5)
    data = []
    for seq in range(600):
        version = rnd.randrange(1, 200)
        at = T0 + dt.timedelta(minutes=version + rnd.choice([0, 1, 2, 60]))
        key, stream = rnd.choice([b"hot", b"hot", b"a", b"b", None]), rnd.randrange(2)
        data.append((key, version, b"", seq, stream, at if rnd.random() < 0.98 else None))
        if rnd.random() < 0.2:
            data.append((key, version, b"", seq, rnd.randrange(2), at + dt.timedelta(minutes=rnd.randrange(90))))
    data.sort(key=lambda r: r[5] or T0)
    reports, run = [], 0
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    skipped = []
    for step in range(5):
        now = T0 + dt.timedelta(minutes=60 * (step + 1))
        for stream in (0, 1):
            for since, upto in ((60 * step - 20 * (step > 0), 60 * step + 30), (60 * step + 30, 60 * step + 45)) + (((10, 40),) if step == 2 else ()):
                run += 1
                reports.append((run, stream, since, upto, now - dt.timedelta(minutes=rnd.randrange(10)), rnd.choice(["succeeded"] * 4 + ["failed"]) if run != 2 else "succeeded", now))
        if step == 3:
            reports.append((2, 0, 0, 200, now, "revoked", now))
        here = [r for r in data if r[5] is None or r[5] <= now]
        path = str(tmp_path / f"feed{step}")
        feed(spark, here).repartitionByRange(8, "arrived_at").sortWithinPartitions("arrived_at").write.parquet(path)
        kept, table = spark.read.parquet(path), spark.createDataFrame(reports, REPORTS)
        # a step that fails before its last part is written leaves nothing
        (tmp_path / f"ledger/step={step}/changes").mkdir(parents=True)
        ledger = incremental.Ledger(spark, ledger.path)
        runs = incremental.successful_runs(table)
        if ledger.first_step(runs) < ledger.steps:
            tail = incremental._skipped(kept, ledger._part(step - 1, "starts"))
            assert "PushedFilters: [Or" in tail._jdf.queryExecution().toString()
            skipped.append(len(here) - tail.count())
        assert {r[0] for r in rows(incremental.unprocessed(kept, table, ledger))} == unread(here, reports)
    assert len(skipped) == 3 and min(skipped) > 0 and ledger.first_step(runs) == 3
    assert {r[0] for r in rows(incremental.unprocessed(kept.limit(0), table, incremental.Ledger(spark, str(tmp_path / "other"))))} == set()


def test_reread_starts_at_the_first_gap(spark):
    t = [T0 + dt.timedelta(hours=h) for h in range(4)]
    runs = spark.createDataFrame([(1, 0, 10, t[1]), (1, 10, 20, t[0]), (1, 25, 30, t[2]), (2, 5, 6, t[3])], "stream_id long, since_version long, upto_version long, read_at timestamp_ntz")
    assert rows(incremental.reread_from(runs)) == [(1, 0, 20, t[2]), (2, 5, 6, t[3])]
