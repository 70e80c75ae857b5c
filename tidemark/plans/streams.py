"""Queries that run a stream to the end of what is there, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.store import LOG, NOW, PREFIX, _LIVE
from tidemark.sources.log import entries
from tidemark.sources.tables import has_key, shared_folder, table
from tidemark.streaming import feed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's files as a stream; the pattern fits a file and a folder of files."""
    return feed.read_stream(spark, f"{folder}/{name}.parque[t]", table(spark, folder, name).schema)


def _ended(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """The result of a stream that has read all there is, from a table in the shared folder."""
    place = f"{shared_folder(spark)}/stream-{uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows" if mode != "append" else f"{place}/rows/batch={number}")

    spark.createDataFrame([], rows.schema).write.parquet(f"{place}/rows" if mode != "append" else f"{place}/rows/batch=-1")
    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    return out.select(*rows.columns)


def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Visible newest writes, by a stream."""
    rows = feed.latest(_stream(spark, folder, "entry_log").where("seq is not null").select("user_key", "version", "seq", F.coalesce("meta", F.lit(0)).alias("meta"), F.coalesce("expires_at", F.lit(0)).alias("expires_at")))
    return feed.visible(_ended(spark, rows, "complete"), NOW).select(F.col("user_key").cast("string").alias("user_key"), "version", "seq")


def stream_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of each stream of the feed, and whether it has ended."""
    return _ended(spark, feed.finished_streams(_stream(spark, folder, "kv_feed")), "complete")


def stream_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Writes to the keys that are subscribed to, committed batch by batch."""
    place = f"{shared_folder(spark)}/commit-{uuid4().hex}"
    rows = feed.subscribe(_stream(spark, folder, "entry_log").where(has_key("user_key")), [PREFIX])
    spark.createDataFrame([], rows.schema).write.parquet(f"{place}/rows/batch=-1")
    feed.group_commit(rows, feed.append_once(f"{place}/rows"), f"{place}/state").awaitTermination()
    done = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    return entries(done, "user_key", "version", "seq").withColumn("user_key", F.col("user_key").cast("string"))


QUERIES.update({f.__name__: f for f in (stream_latest, stream_ends, stream_commit)})
ORACLES.update(
    {
        "stream_latest": f"{LOG} select decode(user_key) as user_key, version, seq from (select *, row_number() over (partition by user_key order by version desc, seq desc) as rn from log) where rn = 1 and {_LIVE}",
        "stream_ends": "select stream_id, count(*) as n, bool_or(coalesce(stream_done, false)) as done from kv_feed group by stream_id",
        "stream_commit": f"{LOG} select decode(user_key) as user_key, version, seq from log where starts_with(decode(user_key), '{PREFIX.decode()}')",
    }
)
