import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators import wal
from tidemark.options import Options
from tidemark.sources import files
from tidemark.store import Store


def test_transactions_of_a_store(spark, tmp_path):
    with Store.open(spark, Options(str(tmp_path / "s"))) as store:
        txn = store.transaction(update=True)
        for i in range(10):
            txn.set(b"key=%d" % i, b"val=%d" % i)
        assert txn.get(b"key=8")["value"] == b"val=8"
        assert txn.commit() == 1
        with pytest.raises(errors.DiscardedTxn):
            txn.commit()
        old = store.transaction()
        store.update(lambda t: (t.delete(b"key=8"), t.set(b"ttl", b"x", expires_at=100), t.set(b"empty", b"")))
        assert old.get(b"key=8")["version"] == 1
        with pytest.raises(errors.KeyNotFound):
            store.view(lambda t: t.get(b"key=8"))
        with pytest.raises(errors.KeyNotFound):
            store.view(lambda t: t.get(b"ttl", now=100))
        assert store.view(lambda t: t.get(b"empty"))["value"] == b""
        assert store.snapshot(now=5).count() == 11 and store.snapshot(read_ts=1).count() == 10
        with pytest.raises(errors.ReadOnlyTxn):
            store.transaction().set(b"a", b"")
        own = store.transaction(update=True)
        own.set(b"key=1", b"own")
        assert dict((r[0], r[2]) for r in rows(own.scan(5)))[b"key=1"] == b"own"
        # the old transaction still reads the first version of key=8
        assert spark.read.parquet(store.compact(2, now=5)).count() == 13 and old.get(b"key=8", now=5)["value"] == b"val=8"
        old.discard()
        path = store.compact(2, now=5)
        assert spark.read.parquet(path).count() == 12
    with pytest.raises(errors.StoreError):
        store.transaction()
    with Store.open(spark, Options(str(tmp_path / "s"))) as again:
        assert again.read_ts == 2


def test_conflicts_and_limits_of_a_store(spark, tmp_path):
    store = Store.open(spark, Options(str(tmp_path / "s"), mem_table_size=1000, namespace_offset=0, banned_namespaces=(5,)))
    a, b = store.transaction(update=True), store.transaction(update=True)
    for t in (a, b):
        with pytest.raises(errors.KeyNotFound):
            t.get(b"k")
        t.set(b"k", b"v")
    a.commit()
    with pytest.raises(errors.Conflict):
        b.commit()
    t = store.transaction(update=True)
    for bad, error in ((b"", errors.EmptyKey), (b"!internal!x", errors.InvalidKey), (b"k" * 65_001, errors.TooLong), ((5).to_bytes(8, "big") + b"k", errors.BannedKey), (b"k" * 200, errors.TxnTooBig)):
        with pytest.raises(error):
            t.set(bad, b"")
    t.set(b"x", b"")
    store.block_writes()
    with pytest.raises(errors.BlockedWrites):
        t.commit()
    store.block_writes(False)
    t.commit()
    store.drop_all()
    assert store.entries().count() == 0


def test_options():
    for bad in ({"value_log_file_size": 5}, {"value_threshold": 0}, {"num_level_zero_tables_stall": 1}):
        with pytest.raises(errors.InvalidOption):
            Options("x", **bad).checked()
    assert Options("x").checked().max_batch_size == 10_066_329


def test_binary_logs(spark, tmp_path):
    data = [(b"a", 1, b"plain", 0, 0, 0), (b"a", 2, b"in txn", 64, 1, 0), (b"b", 2, b"", 65, 0, 99), (b"!", 2, b"2", 128, 0, 0), (b"c", 3, b"open", 64, 0, 0)]
    log = spark.createDataFrame(data, "user_key binary, version long, value binary, meta int, user_meta int, expires_at long").coalesce(1)
    parts = [bytes(r.entry) for r in files.encoded(log).collect()]
    folder = tmp_path / "wal"
    folder.mkdir()
    (folder / "00001.mem").write_bytes(bytes(20) + b"".join(parts))
    (folder / "00002.mem").write_bytes(bytes(20) + parts[0] + parts[1][:-1] + b"!" + parts[2])
    (folder / "00003.mem").write_bytes(bytes(20))
    (folder / "x.mem").write_bytes(b"")
    assert [r.fid for r in files.listed(spark, str(folder), ".mem").collect()] == [1, 2, 3]
    assert files.repeated_ids(files.listed(spark, str(folder), ".mem")).count() == 0
    got = files.read_log_files(spark, str(folder))
    first = got.where("fid = 1").orderBy("offset").select("key", "version", "value", "meta", "user_meta", "expires_at")
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in first.collect()] == data
    assert got.where("fid = 2").count() == 1
    frames = files.framed(got)
    assert [bytes(r.value) for r in wal.replay(frames).where("fid = 1").orderBy("offset").collect()] == [b"plain", b"in txn", b""]
    assert dict(rows(wal.valid_end(frames.select("fid", "offset", "size", "kind", "ts"))))[1] == 20 + sum(map(len, parts[:4]))


def test_sinks(spark, tmp_path):
    log = spark.range(1000).select(F.encode(F.lpad(F.col("id").cast("string"), 4, "0"), "UTF-8").alias("user_key"), F.col("id").alias("version"), F.col("id").alias("seq"))
    files.write_table(log, str(tmp_path / "t"), 4)
    with pytest.raises(Exception, match="already exists"):
        files.write_table(log, str(tmp_path / "t"), 4)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4 and spark.read.parquet(str(tmp_path / "t")).count() == 1000
    assert files.open_or_create(spark, str(tmp_path / "m"), files.MANIFEST).count() == 0
    files.publish_snapshot(log.limit(3), str(tmp_path / "snap"), 1)
    files.publish_snapshot(log.limit(4), str(tmp_path / "snap"), 2)
    assert files.current_snapshot(spark, str(tmp_path / "snap")).count() == 4


def test_checksums_of_entries_cover_the_version(spark, tmp_path):
    from tidemark.functions.codec import crc32c_of
    from tidemark.plans.store import checksum_verify

    schema = "user_key binary, version long, value binary, meta int, user_meta int, expires_at long, fid long, log_offset long, seq long, table_id long"
    log = spark.createDataFrame([(b"k", v, b"x", 1, 2, 300, 1, 20 * v, v, None) for v in (1, 2, 3)], schema)
    log.write.parquet(str(tmp_path / "entry_log.parquet"))
    want = {v: int(crc32c_of([b"\x01\x02\x09\x01\xac\x02k" + (2**64 - 1 - v).to_bytes(8, "big") + b"x"])[0]) for v in (1, 2, 3)}
    assert {r.seq: (r.crc, r.ok) for r in checksum_verify(spark, str(tmp_path)).collect()} == {v: (c, True) for v, c in want.items()} and len(set(want.values())) == 3
    entries = [bytes(r.entry) for r in files.encoded(log).orderBy("seq").collect()]
    spoilt = [entries[0], entries[1][:-5] + b"y" + entries[1][-4:], entries[2][:-1], b"abc", None]
    got = files.verified(spark.createDataFrame(list(enumerate(spoilt)), "i long, entry binary")).collect()
    assert [r.ok for r in sorted(got, key=lambda r: r.i)] == [True, False, False, False, False]


def keys(df):
    return sorted((bytes(r.user_key), r.version, bytes(r.value)) for r in df.collect())


def test_a_store_of_levels(spark, tmp_path):
    options = Options(str(tmp_path / "s"), mem_table_size=2000, num_memtables=2, num_level_zero_tables=2, num_level_zero_tables_stall=3, base_level_size=1 << 13, base_table_size=1 << 12)
    store = Store.open(spark, options)
    for i in range(6):
        store.update(lambda t, i=i: [t.set(b"k%d" % (j % 7), b"%d-%d" % (i, j)) for j in range(i, i + 9)])
        if i == 2:
            reader = store.transaction()
            before = keys(store.snapshot(now=5))
        if i == 3:
            store.update(lambda t: t.delete(b"k3"))
        if i % 2:
            store.flush()
    now = keys(store.snapshot(now=5))
    assert len(store.tables()) == 3 and set(store.tables().values()) == {0} and len(store._segments()) <= 2 and store.full_level() == 0
    store.maintain()
    assert store.full_level() is None and 0 not in store.tables().values() and keys(store.snapshot(now=5)) == now
    # what an open transaction reads stays, however often levels are merged
    store.compact(2, now=5)
    assert keys(reader.scan(5)) == before
    assert keys(store.snapshot(3, now=5)) == before and store.entries().groupBy("user_key").count().agg({"count": "max"}).first()[0] > 1
    reader.discard()
    path = store.compact(2, now=5, drop=True)
    assert keys(store.snapshot(now=5)) == now == keys(spark.read.parquet(path)) and len(store.tables()) == 1
    assert len(list((tmp_path / "s/tables").iterdir())) == 1 and store._segments() == []
    from tidemark.sources import binary

    assert store.export(str(tmp_path / "out"), b"Test", 8) == 1
    assert sorted((bytes(r.key), r.version, bytes(r.value)) for r in binary.read_tables(spark, str(tmp_path / "out"), verify_blocks=True).collect()) == now
    assert [(r.op, r.table_id) for r in binary.read_manifest(spark, str(tmp_path / "out"), b"Test", 8).collect()] == [("CREATE", *store.tables())]
    # a flush that failed before its row, and one behind it
    store.update(lambda t: t.set(b"new", b"1"))
    segment = store._segments()[0]
    files.write_table(spark.read.parquet(store._segment(segment)), store._table(999), 1)
    again = Store.open(spark, options)
    assert not (tmp_path / "s/tables/999").exists() and keys(again.snapshot(now=5)) == sorted([*now, (b"new", 8, b"1")]) and again.read_ts == 8
    files.write_table(spark.read.parquet(again._segment(segment)), again._table(segment), 1)
    again._change([(segment, 0)])
    third = Store.open(spark, options)
    assert third._segments() == [] and keys(third.snapshot(now=5)) == sorted([*now, (b"new", 8, b"1")])
    files.remove(spark, third._table(segment))
    with pytest.raises(errors.MissingTables):
        Store.open(spark, options)


def test_tombstones_stay_above_older_levels(spark, tmp_path):
    store = Store.open(spark, Options(str(tmp_path / "s")))
    store.update(lambda t: (t.set(b"a", b"1"), t.set(b"b", b"1")))
    store.flush()
    for level in (0, 1, 2):
        store.merge(level)
    store.update(lambda t: (t.delete(b"a"), t.set(b"b", b"2", expires_at=10)))
    store.flush()
    store.merge(0, now=20)
    assert keys(store.snapshot(now=20)) == [] and sorted(store.tables().values()) == [1, 3]
    store.compact(1, now=20, drop=True)
    assert store.entries().count() == 0


def test_commits_are_forgotten(spark, tmp_path):
    store = Store.open(spark, Options(str(tmp_path / "s")))
    reader = store.transaction(update=True)
    for i in range(3):
        store.update(lambda t, i=i: t.set(b"k%d" % i, b""))
    assert store._commits == {b"k0": 1, b"k1": 2, b"k2": 3}
    reader.reads.add(b"k1")
    reader.set(b"x", b"")
    with pytest.raises(errors.Conflict):
        reader.commit()
    store.update(lambda t: t.set(b"y", b""))
    assert store._commits == {} and store.reads.done_until == 3


def test_watermark():
    from threading import Thread

    from tidemark.operators.watermark import Watermark

    mark = Watermark()
    mark.begin(1, 2, 2, 5)
    mark.done(2)
    assert mark.done_until == 0 and mark.lowest_open == 1
    mark.done(1)
    assert mark.done_until == 1 and not mark.wait(2, 0.01) and mark.wait(1)
    done = Thread(target=lambda: mark.wait(5, 10))
    done.start()
    mark.done(2, 5)
    done.join(5)
    assert not done.is_alive() and mark.done_until == 5 and mark.lowest_open is None
