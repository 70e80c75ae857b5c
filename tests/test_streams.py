import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import mvcc
from tidemark.streaming import expiry, feed

T0 = dt.datetime(2025, 6, 1)
SCHEMA = "user_key binary, version long, seq long, meta int, expires_at long, at timestamp"


def entries(spark, tmp_path, batches):
    for i, data in enumerate(batches):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return feed.read_stream(spark, str(tmp_path / "in/*"), spark.createDataFrame([], SCHEMA).schema, 1)


def collected(spark, rows_of, mode, tmp_path):
    out = []
    rows_of.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, n: out.append([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in b.collect()])).start().awaitTermination()
    return out


DATA = [
    [(b"a", 1, 1, 0, 0, T0), (b"b", 1, 2, 0, 0, T0), (b"a", 3, 5, 1, 0, T0)],
    [(b"a", 2, 3, 0, 0, T0), (b"c", 1, 4, 0, 5, T0), (None, 1, 9, 0, 0, T0), (b"b", 1, 2, 0, 0, T0)],
]


def test_stream_equals_batch(spark, tmp_path):
    stream = entries(spark, tmp_path, DATA)
    last = collected(spark, feed.latest(stream), "complete", tmp_path)[-1]
    batch = mvcc.newest(spark.createDataFrame([r for d in DATA for r in d if r[0]], SCHEMA)).select(*feed.latest(stream).columns)
    assert sorted(r[:3] for r in last) == [r[:3] for r in rows(batch)]
    live = feed.visible(spark.createDataFrame(last, feed.latest(stream).schema), 5)
    assert [r[0] for r in rows(live)] == [b"b"]


def test_copies_and_subscriptions(spark, tmp_path):
    stream = entries(spark, tmp_path, DATA)
    once = collected(spark, feed.distinct_writes(feed.subscribe(stream, [b"b", b"zz"]), "at", "1 hour"), "append", tmp_path)
    assert [r[2] for b in once for r in b] == [2]


def test_group_commit_is_repeatable(spark, tmp_path):
    stream = entries(spark, tmp_path, DATA)
    feed.group_commit(stream, feed.append_once(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    feed.append_once(str(tmp_path / "out"))(spark.createDataFrame(DATA[0], SCHEMA), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(map(len, DATA))


def test_expiry(spark, tmp_path):
    soon = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) + 60
    data = [[(b"a", 1, 1, 0, soon, T0), (b"b", 1, 2, 0, 0, T0)], [(b"c", 1, 3, 0, 0, T0 + dt.timedelta(hours=2))], [(b"b", 2, 4, 1, 0, T0 + dt.timedelta(hours=3))]]
    out = collected(spark, expiry.expiring(entries(spark, tmp_path, data), "at", "1 minute"), "append", tmp_path)
    flat = [r for b in out for r in b]
    assert (b"a", 1, soon, True) in flat and (b"a", 1, soon, False) in flat and (b"b", 2, 0, False) in flat
    assert [r for r in flat if r[0] == b"c"] == [(b"c", 1, 0, True)]


def test_open_marks(spark, tmp_path):
    marks = spark.createDataFrame([("x", 1, "begin"), ("x", 1, "done"), ("x", 2, "begin")], "name string, idx long, kind string")
    assert rows(feed.low_watermark_state(marks)) == [("x", 1, 0), ("x", 2, 1)]
    ends = spark.createDataFrame([(1, True), (1, None), (2, None)], "stream_id long, stream_done boolean")
    assert rows(feed.finished_streams(ends.withColumn("k", F.lit(1)))) == [(1, 2, True), (2, 1, False)]
