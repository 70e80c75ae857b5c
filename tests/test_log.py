import random

import pytest
from conftest import rows

from tidemark.operators import greedy, manifest, txn, vlog, wal, watermark


def replay_model(log):
    """Entries of one file read in order: (kept offsets, valid end)."""
    kept, held, open_ts, end = [], [], 0, 20
    for off, kind, ts in log:
        if kind == "T":
            if open_ts == 0:
                open_ts = ts
            if ts != open_ts:
                break
            held.append(off)
        elif kind == "F":
            if ts != open_ts:
                break
            kept += held
            held, open_ts, end = [], 0, off + 10
        else:
            if open_ts:
                break
            kept.append(off)
            end = off + 10
    return kept, end


def test_replay_against_a_model(spark):
    rnd = random.Random(3)
    files = {f: [(20 + 10 * i, rnd.choice("PTTF"), rnd.choice([1, 1, 1, 2])) for i in range(rnd.randrange(1, 9))] for f in range(150)}
    # finishing rows that follow nothing open are bad
    df = spark.createDataFrame([(f, o, 10, k, t) for f, log in files.items() for o, k, t in log], "fid long, offset long, size long, kind string, ts long")
    kept, ends = wal.replay(df), dict(rows(wal.valid_end(df)))
    got = {}
    for r in kept.collect():
        got.setdefault(r.fid, []).append(r.offset)
    for f, log in files.items():
        want, end = replay_model(log)
        assert (sorted(got.get(f, [])), ends[f]) == (sorted(want), end)
    assert wal.truncated(df).where("offset < 0").count() == 0
    assert wal.replay(df.limit(0)).count() == 0


def test_manifest(spark):
    data = [(1, "CREATE", 7, 0, 0), (1, "CREATE", 7, 0, 0), (2, "0", 8, 1, 0), (3, "delete", 7, None, None), (4, "1", 9, None, None), (5, "create ", 8, 2, 0), (6, None, 8, 0, 0), (7, "MERGE", 8, 0, 0), (8, "CREATE", None, 0, 0)]
    log = spark.createDataFrame(data, "seq long, op string, table_id long, level int, key_id long")
    assert rows(manifest.state(log)) == [(8, 2, 0, 5)]
    assert rows(manifest.errors(log)) == [(4, 9, "missing"), (5, 8, "exists")]
    assert rows(manifest.counts(log)) == [(3, 2, 1)]
    assert rows(manifest.counts(log.limit(0))) == [(0, 0, 0)]


def test_levels(spark):
    info = spark.createDataFrame([(1, 0, b"a", b"z"), (2, 0, b"b", b"c"), (3, 1, b"a", b"c"), (4, 1, b"c", b"d"), (5, 1, b"x", b"e"), (5, 1, b"x", b"e")], "table_id long, level int, smallest binary, biggest binary")
    from pyspark.sql import functions as F

    info = info.select("*", *[F.lit(1).cast("long").alias(c) for c in ("smallest_ver", "key_count", "on_disk_size", "max_version")])
    assert rows(manifest.overlaps(info)) == [(1, 4, "overlap"), (1, 5, "inverted")]
    assert [r.table_id for r in manifest.in_order(info).collect()] == [1, 2, 3, 4, 5]


def test_discards(spark):
    log = [(100 * i + f, f, 100 * f) for i, f in enumerate(range(20))] + [(10_000 + f, f, -1) for f in range(10)]
    df = spark.createDataFrame(log, "seq long, fid long, delta long")
    assert rows(vlog.discard_stats(df)) == sorted(((f, 0 if f < 10 else 100 * f) for f in range(1, 20)), key=repr)
    assert rows(vlog.max_discard(vlog.discard_stats(df))) == [(19, 1900)]
    rnd = random.Random(5)
    log = [(i, rnd.randrange(6), rnd.choice([-5, 0, 3, 4])) for i in range(300)]
    state = {}
    for _, f, d in log:
        if d > 0:
            state[f] = state.get(f, 0) + d
        elif d < 0 and f in state:
            state[f] = 0
    assert dict(rows(vlog.discard_stats(spark.createDataFrame(log, "seq long, fid long, delta long")))) == state
    assert rows(vlog.max_discard(vlog.discard_stats(df.limit(0)))) == []


def test_ties_of_discards_go_to_the_lowest_file(spark):
    assert rows(vlog.max_discard(spark.createDataFrame([(3, 5), (2, 5)], "fid long, discarded long"))) == [(2, 5)]


@pytest.mark.parametrize("seed", range(4))
def test_low_watermark(spark, seed):
    rnd = random.Random(seed)
    begun, done = list(range(1, 15)), {i for i in range(1, 15) if rnd.random() < 0.7}
    marks = spark.createDataFrame([("x", i, "begin") for i in begun] + [("x", i, "done") for i in done], "name string, idx long, kind string")
    want = 0
    for i in begun:
        if i not in done:
            break
        want = i
    assert rows(watermark.low_watermark(marks)) == [("x", want)]
    assert [r[1] for r in rows(watermark.pending(marks))] == sorted(set(begun) - done, key=lambda i: repr(("x", i, 1)))


def test_greedy_rotation_and_files(spark):
    rnd = random.Random(6)
    data = [(g, i, rnd.randrange(1, 40)) for g in (1, 2) for i in range(300)]
    df = spark.createDataFrame(data, "g long, i long, n long").repartition(7)
    got = {(r.g, r.i): (r.segment, r.offset) for r in greedy.streamed(df, "g", ["i"], ["n"], greedy.rotate(100), "segment long, offset long").collect()}
    for g in (1, 2):
        segment = used = 0
        for _, i, n in (x for x in data if x[0] == g):
            if used >= 100:
                segment, used = segment + 1, 0
            assert got[g, i] == (segment, used)
            used += n
    got = {(r.g, r.i): (r.fid, r.offset) for r in greedy.streamed(df, "g", ["i"], ["n"], greedy.value_files(100, 4), "fid long, offset long").collect()}
    for g in (1, 2):
        fid, off, k = 1, 20, 0
        for _, i, n in (x for x in data if x[0] == g):
            assert got[g, i] == (fid, off)
            off, k = off + n, k + 1
            if off > 100 or k > 4:
                fid, off, k = fid + 1, 20, 0
    assert greedy.streamed(df.limit(0), "g", ["i"], ["n"], greedy.rotate(100), "segment long, offset long").count() == 0


def test_blocks_of_ten_thousand_keys(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import codec

    df = spark.range(10_000).select(F.lit(1).alias("t"), "id", F.encode(F.lower(F.lpad(F.hex("id"), 16, "0")), "UTF-8").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("v"))
    df = df.select("t", "id", codec.key_with_version(F.col("k"), F.col("id") + 1).alias("key"), codec.value_bytes(F.col("v"), F.lit(0).cast("long")).cast("long").alias("size"))
    out = greedy.streamed(df, "t", ["id"], ["key", "size"], greedy.blocks(4096), "block long, base_key binary, overlap int, lcp int, begins long").orderBy("id").collect()
    block, base, end, n = 0, None, 0, 0
    for r in out:
        key = bytes(r.key)
        if n and end + 6 + len(key) + r.size + (n + 1) * 4 + 16 > 4096:
            block, base, end, n = block + 1, None, 0, 0
        base = base or key
        shared = next((i for i in range(min(len(key), len(base))) if key[i] != base[i]), 0)
        shared = 0 if n == 0 else shared
        assert (r.block, bytes(r.base_key), r.overlap, r.begins) == (block, base, shared, end)
        end, n = end + 4 + len(key) - shared + r.size, n + 1


def test_transactions(spark):
    writes = spark.createDataFrame([(1, b"a", b"x" * 10, 1), (1, b"a", b"y" * 20, 2), (1, b"b", b"z", 3), (2, b"c", b"", 4)], "txn long, user_key binary, value binary, seq long")
    assert [r[3] for r in rows(txn.last_pending(writes))] == [2, 3, 4]
    sized = txn.sizes(writes, 15, 66)
    # 21 at first; a long value counts as a pointer; the limit itself is too big
    assert {r.seq: (r.size, r.too_big) for r in sized.collect()} == {1: (44, False), 2: (69, True), 3: (83, True), 4: (34, False)}
    assert rows(txn.too_big(sized)) == [(1, 2, 69)]


def test_conflicts_against_brute_force(spark):
    rnd = random.Random(7)
    commits = sorted({(rnd.choice([b"a", b"b"]), rnd.randrange(500)) for _ in range(120)})
    reads = [(i, k, ts - rnd.randrange(1, 200), ts) for i, (k, ts) in enumerate(commits)]
    got = {r[0]: r[1:] for r in rows(txn.conflicts(spark.createDataFrame(commits, "user_key binary, commit_ts long"), spark.createDataFrame(reads, "txn long, user_key binary, read_ts long, commit_ts long"), spans=7))}
    for i, k, lo, hi in reads:
        hit = [t for k2, t in commits if k2 == k and lo < t < hi]
        assert got.get(i) == ((len(hit), min(hit)) if hit else None)


def test_key_rules(spark):
    data = [(None, b""), (b"", b""), (b"!x", b""), (b"k" * 65_001, b""), (b"k", b"v" * 6), (b"k" * 65_000, b"v" * 5), (b"k", None)]
    got = [r.status for r in txn.checked(spark.createDataFrame(data, "user_key binary, value binary").coalesce(1), b"!x", 5).collect()]
    assert got == ["EmptyKey", "EmptyKey", "InvalidKey", "KeyTooLong", "ValueTooLong", "Ok", "Ok"]
    assert txn.checked(spark.createDataFrame(data[:1], "user_key binary, value binary"), b"!", 5, read_only=True).first().status == "ReadOnlyTxn"


def test_bans(spark):
    keys = spark.createDataFrame([(b"x" + (5).to_bytes(8, "big"),), (b"x" + (5).to_bytes(8, "big") + b"k",), (b"x" + (6).to_bytes(8, "big") + b"k",), (None,)], "user_key binary")
    assert [r.banned for r in txn.banned(keys.coalesce(1), 1, [5]).collect()] == [False, True, False, False]
    assert [r.banned for r in txn.banned(keys, -1, [5]).collect()] == [False] * 4


def test_checksums_by_mode(spark):
    from tidemark.operators import checksums

    entries = spark.createDataFrame([(1, 0, 0, b"ab"), (1, 0, 2, b"cd"), (1, 1, 0, b"x"), (2, 0, 0, b"y")], "table_id long, block long, begins long, entry binary")
    blocks = checksums.block_sums(entries)
    assert {(r.table_id, r.block): bytes(r.data) for r in blocks.collect()} == {(1, 0): b"abcd", (1, 1): b"x", (2, 0): b"y"}
    tables = checksums.table_sums(blocks)
    assert all(rows(checksums.broken(blocks, tables, m)) == [] for m in checksums.MODES)
    spoilt = blocks.selectExpr("table_id", "block", "data", "if(table_id = 1 and block = 1, crc + 1, crc) as crc")
    assert rows(checksums.broken(spoilt, tables, "none")) == [] and rows(checksums.broken(spoilt, tables, "block")) == [(1, 1)]
    assert rows(checksums.broken(spoilt, tables, "table")) == [(1, None)] and len(rows(checksums.broken(spoilt, tables, "both"))) == 2
    assert rows(checksums.broken(blocks.where("block = 0"), tables, "table")) == [(1, None)]
    with pytest.raises(ValueError):
        checksums.broken(blocks, tables, "some")


def test_order_by_ranges(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import ranges

    df = spark.createDataFrame([(i % 3, i) for i in range(200)], "g long, i long")
    order = ["g", "i"]
    want = sorted((i % 3, i) for i in range(200))
    assert [r[2] for r in sorted(map(tuple, ranges.numbered(df, order, "n", 5).collect()))] == list(range(5, 205))
    got = {(r.g, r.i): r._prior and r._prior.i for r in ranges.before(df, order, F.struct("i")).collect()}
    assert got == {p: None if k == 0 else want[k - 1][1] for k, p in enumerate(want)}
    down = sorted(((i % 3, -i) for i in range(200)))
    got = {(r.g, r.i): r._prior and r._prior.i for r in ranges.before(df, ["g", ranges.By("i", True)], F.struct("i")).collect()}
    assert got == {(g, -i): None if k == 0 else -down[k - 1][1] for k, (g, i) in enumerate(down)}
    assert ranges.before(df.limit(0), order, F.struct("i")).count() == 0 and ranges.numbered(df.limit(0), order, "n").count() == 0
    odd = spark.createDataFrame([(None, 1), (None, 2), (b"", 1), (b"a", None), (b"a", 5)], "k binary, v long")
    assert [r.n for r in ranges.numbered(odd, ["k", ranges.By("v", True)], "n").orderBy(F.asc("k"), F.desc("v")).collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("reuse", [True, False])
def test_numbers_of_rows_with_other_columns(spark, reuse):
    """Each number once and each row's predecessor right, whatever columns are read, with exchange reuse or without."""
    from pyspark.sql import functions as F

    from tidemark.operators import ranges

    n = 1_500_000
    df = spark.range(n).select((F.col("id") * 48_271 % 1_500_007).alias("key"), F.xxhash64("id").alias("payload"))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        placed = ranges.numbered(df, ["key"], "n")
        found = placed.agg(F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.bit_xor("payload").alias("x")).first()
        assert tuple(found)[:3] == (n, 0, n - 1) and found.x == df.agg(F.bit_xor("payload")).first()[0]
        prior = ranges.before(df, ["key"], F.struct("key")).agg(
            F.count("*").alias("rows"), F.count("_prior").alias("priors"), F.sum(F.col("key") - F.col("_prior.key")).alias("steps"), F.count_if(F.col("_prior.key") >= F.col("key")).alias("wrong"), F.count("payload").alias("kept")
        )
        ends = df.agg(F.max("key") - F.min("key")).first()[0]
        assert tuple(prior.first()) == (n, n - 1, ends, 0, n)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_a_value_log_opened_again(spark):
    schema = "writer long, seq long, user_key binary, value binary, meta int, expires_at long"
    batches = [spark.createDataFrame([(w, 100 * b + i, b"k%d" % i, b"%d-%d-%d-" % (b, w, i) + b"x" * 40, 0, 0) for w in (1, 2) for i in range(3 + w)], schema) for b in (0, 1)]
    first = vlog.write(batches[0], 10, 120, 100)
    second = vlog.write(batches[1], 10, 120, 100, existing=first)
    written = first.unionByName(second)
    assert written.select("writer", "fid", "offset").distinct().count() == written.count() == 18
    for w in (1, 2):
        assert second.where(f"writer = {w}").agg({"fid": "min"}).first()[0] == first.where(f"writer = {w}").agg({"fid": "max"}).first()[0] + 1
    entries = vlog.with_pointers(batches[1], vlog.places(batches[1], 10, 120, 100, existing=first))
    assert rows(vlog.dereferenced(entries, written).select("writer", "seq", "value")) == rows(batches[1].select("writer", "seq", "value"))
    files = spark.createDataFrame([(1, 1, 90, 90), (1, 2, 20, 20), (1, 3, 200, 150), (2, 4, 20, 20)], "writer long, fid long, size long, valid_end long")
    assert rows(vlog.opened(files)) == [(1, 1, 90), (1, 3, 150), (2, 4, 20)]
