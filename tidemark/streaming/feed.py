"""Streams of entries and of KV messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.codec import DELETE, POINTER_BYTES, has
from tidemark.operators import greedy, vlog
from tidemark.options import Options
from tidemark.sources.tables import has_key


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder or pattern; `max_files` a batch holds it back as a stall would."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def latest(entries: DataFrame) -> DataFrame:
    """Each key's newest write so far, for complete or update mode: state is one row a key."""
    place = F.struct("version", "seq")
    fields = [c for c in entries.columns if c != "user_key"]
    newest = F.max_by(F.struct(*fields), place)
    return entries.where(has_key("user_key") & F.col("version").isNotNull()).groupBy("user_key").agg(newest.alias("_n")).select("user_key", "_n.*")


def visible(rows: DataFrame, now: int) -> DataFrame:
    """Rows of `latest` that are neither deleted nor expired."""
    return rows.where(~has("meta", DELETE) & ((F.coalesce("expires_at", F.lit(0)) == 0) | (F.col("expires_at") > now)))


def distinct_writes(entries: DataFrame, time: str, late: str) -> DataFrame:
    """Each seq once: copies that come within `late` of the first are dropped, as is what comes behind the watermark."""
    return entries.withWatermark(time, late).dropDuplicatesWithinWatermark(["seq"])


def subscribe(entries: DataFrame, prefixes: list[bytes]) -> DataFrame:
    """Writes to keys with one of the prefixes; none without prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(F.col("user_key"), F.lit(p))
    return entries.where(hit)


def ignored_places(spec: str) -> set[int]:
    """The byte places that a list such as "1, 2-3, 9" names, from 0 on."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition("-")
        out.update(range(int(first), int(last or first) + 1))
    return out


def matching(rows: DataFrame, matches: list[tuple[bytes, str]], key: str = "user_key") -> DataFrame:
    """Rows whose key begins with one of the prefixes, but for the bytes that the list beside it ignores; none without matches.

    A key must be as long as the prefix. Runs of bytes that count are compared as they are.
    """
    hit = F.lit(False)
    for prefix, spec in matches:
        ignored = ignored_places(spec)
        own = F.octet_length(key) >= len(prefix)
        begin = 0
        for at in range(len(prefix) + 1):
            if at == len(prefix) or at in ignored:
                if at > begin:
                    own = own & (F.substr(F.col(key), F.lit(begin + 1), F.lit(at - begin)) == F.lit(prefix[begin:at]))
                begin = at + 1
        hit = hit | own
    return rows.where(hit)


def finished_streams(feed: DataFrame) -> DataFrame:
    """(stream_id, n, done): messages of each stream so far, and whether its end was marked."""
    return feed.groupBy("stream_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("stream_done", F.lit(False))).alias("done"))


def low_watermark_state(marks: DataFrame) -> DataFrame:
    """(name, idx, open): open begins of each index so far; `operators.watermark` reads the low watermark off its result."""
    change = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "done", -1).otherwise(0)
    return marks.groupBy("name", "idx").agg(F.sum(change).alias("open"))


def group_commit(entries: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Applies each micro-batch of writes as one commit, under its number: a repeated batch has the same number,
    so `apply` can leave out what it has applied. Without `every`, what is there is applied and the query ends."""
    writer = entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A commit that writes each batch to a folder of its own number: writing it again replaces it."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def apply_batch(path: str, options: Options, writer: str = "writer") -> Callable[[DataFrame, int], None]:
    """A commit that takes a batch of write requests through the whole pipeline: large values go to the value log, each
    writer's entries, with pointers in their place, to memtables that are full at their size, in groups of
    `write_batch_rows`. All below a folder of the batch's number: writing it again replaces it.

    A batch has (writer, seq, user_key, version, value, meta, user_meta, expires_at). While
    level 0 is stalled it is `read_stream`'s `max_files` that holds batches back.
    """

    def apply(batch: DataFrame, number: int) -> None:
        limits = (options.value_threshold, options.value_log_file_size, options.value_log_max_entries)
        at = f"{path}/batch={number}"
        vlog.write(batch, *limits, writer=writer).write.mode("overwrite").parquet(f"{at}/values")
        pointed = vlog.with_pointers(batch, vlog.places(batch, *limits, writer=writer), writer)
        n = (F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(POINTER_BYTES))).cast("long")
        held = greedy.streamed(pointed.withColumn("n", n), writer, ["seq"], ["n"], greedy.rotate(options.mem_table_size), "memtable long, offset long")
        grouped = greedy.numbered(held.drop("n", "offset"), writer, ["seq"]).withColumn("commit_group", F.floor(F.col("row_no") / options.write_batch_rows))
        grouped.drop("row_no").write.mode("overwrite").parquet(f"{at}/entries")

    return apply


def applied(spark: SparkSession, path: str, writer: str = "writer") -> DataFrame:
    """The entries of all batches that `apply_batch` has written, with their values read back from the value log."""
    entries = spark.read.option("basePath", path).parquet(f"{path}/batch=*/entries")
    values = spark.read.option("basePath", path).parquet(f"{path}/batch=*/values").withColumn(writer, F.struct(writer, "batch"))
    return vlog.dereferenced(entries.withColumn(writer, F.struct(writer, "batch")), values, writer).withColumn(writer, F.col(f"{writer}.{writer}"))
