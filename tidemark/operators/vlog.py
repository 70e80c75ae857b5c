"""Values kept apart from keys: files of large values, pointers to them, and what of them is garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import CRC_BYTES, FIN_TXN, MAX_HEADER, TXN, VALUE_POINTER, entry_bytes
from tidemark.operators import greedy


def split(log: DataFrame, threshold: int) -> DataFrame:
    """`log` with `inline`: whether a value is below the threshold and stays with its key; a value of just that size doesn't."""
    return log.withColumn("inline", F.octet_length("value") < threshold)


def opened(files: DataFrame, writer: str = "writer") -> DataFrame:
    """(writer, fid, size) of the files a value log goes on with, from (writer, fid, size, valid_end).

    Empty files that aren't a writer's last are left out; its last ends where its valid entries do.
    """
    last = files.groupBy(writer).agg(F.max("fid").alias("_last"))
    rows = files.join(last, writer).where((F.col("size") != greedy.FILE_HEAD) | (F.col("fid") == F.col("_last")))
    return rows.select(writer, "fid", F.when(F.col("fid") == F.col("_last"), F.col("valid_end")).otherwise(F.col("size")).alias("size"))


def places(log: DataFrame, threshold: int, limit_bytes: int, limit_entries: int, writer: str = "writer", existing: DataFrame | None = None) -> DataFrame:
    """(writer, seq, len, fid, offset) of each value that isn't inline.

    Each writer fills its own files in order of seq; `fid` counts them from 1, or from the
    one after the writer's highest in `existing` (writer, fid). `len` is the encoded entry
    with header and checksum. Lengths alone are shuffled, not the values.
    """
    large = split(log, threshold).where("not inline")
    lengths = large.select(writer, "seq", entry_bytes(F.col("user_key"), F.col("value"), F.col("expires_at")).cast("long").alias("len"))
    placed = greedy.streamed(lengths, writer, ["seq"], ["len"], greedy.value_files(limit_bytes, limit_entries), "fid long, offset long")
    if existing is None:
        return placed
    highest = existing.groupBy(writer).agg(F.max("fid").alias("_highest"))
    return placed.join(highest, writer, "left").withColumn("fid", F.col("fid") + F.coalesce("_highest", F.lit(0))).drop("_highest")


def write(log: DataFrame, threshold: int, limit_bytes: int, limit_entries: int, writer: str = "writer", existing: DataFrame | None = None) -> DataFrame:
    """The value log: the entries whose values aren't inline at their places, without transaction bits."""
    large = split(log, threshold).where("not inline").drop("inline")
    large = large.withColumn("meta", F.col("meta").bitwiseAND(~(TXN | FIN_TXN) & 0xFF))
    return large.join(places(log, threshold, limit_bytes, limit_entries, writer, existing), [writer, "seq"])


def with_pointers(log: DataFrame, written: DataFrame, writer: str = "writer") -> DataFrame:
    """The entries as a memtable holds them: inline values as they are, others a pointer struct and its meta bit set."""
    place = written.select(writer, "seq", F.struct("fid", "len", "offset").alias("pointer"))
    rows = log.join(place, [writer, "seq"], "left")
    to = F.col("pointer").isNotNull()
    meta = F.when(to, F.col("meta").bitwiseOR(VALUE_POINTER)).otherwise(F.col("meta").bitwiseAND(~VALUE_POINTER & 0xFF))
    return rows.withColumn("meta", meta).withColumn("value", F.when(~to, F.col("value")))


def dereferenced(entries: DataFrame, written: DataFrame, writer: str = "writer") -> DataFrame:
    """The entries with their values read back through the pointers: an equi-join on (writer, fid, offset)."""
    values = written.select(F.col(writer).alias("_w"), F.col("fid").alias("_fid"), F.col("offset").alias("_offset"), F.col("value").alias("_value"))
    on = (F.col(writer) == F.col("_w")) & (F.col("pointer.fid") == F.col("_fid")) & (F.col("pointer.offset") == F.col("_offset"))
    return entries.join(values, on, "left").withColumn("value", F.coalesce("value", "_value")).drop("_w", "_fid", "_offset", "_value")


def request_sizes(log: DataFrame, request: str) -> DataFrame:
    """(writer, request, size): the most bytes that each request's entries can take in the log."""
    each = F.octet_length("user_key") + F.octet_length("value") + MAX_HEADER + CRC_BYTES
    return log.groupBy("writer", request).agg(F.sum(each).cast("long").alias("size"))


def discard_stats(log: DataFrame) -> DataFrame:
    """(fid, discarded): bytes discarded of each value file.

    `log` has (seq, fid, delta): a positive delta adds, a negative one resets to 0, a zero
    only reads. A file appears with its first positive delta. The last reset is found
    first, by an aggregate, so no file's updates are gathered.
    """
    rows = log.where("fid is not null and delta is not null and seq is not null")
    each = rows.groupBy("fid", F.pmod(F.xxhash64("seq"), F.lit(32)).alias("_salt")).agg(F.max(F.when(F.col("delta") < 0, F.col("seq"))).alias("_reset"), F.max("delta").alias("_most"))
    resets = each.groupBy("fid").agg(F.max("_reset").alias("_reset"), F.max("_most").alias("_most")).where("_most > 0")
    after = rows.where("delta > 0").join(resets, "fid").where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
    sums = after.groupBy("fid").agg(F.sum("delta").alias("discarded"))
    return resets.select("fid").join(sums, "fid", "left").select("fid", F.coalesce("discarded", F.lit(0)).cast("long").alias("discarded"))


def max_discard(stats: DataFrame) -> DataFrame:
    """(fid, discarded) of the file with most to discard, the lowest among equals: at most one row."""
    return stats.orderBy(F.desc("discarded"), "fid").limit(1)


def superseded(log: DataFrame) -> DataFrame:
    """(fid, bytes): bytes of pointed values in each file that a newer write of the key has made garbage."""
    last = Window.partitionBy("user_key").orderBy(F.desc("version"), F.desc("seq"))
    newest = log.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("user_key", F.col("seq").alias("_newest"))
    old = log.where(F.col("meta").bitwiseAND(VALUE_POINTER) != 0).join(newest, "user_key").where("seq <> _newest")
    return old.groupBy("fid").agg(F.sum(F.octet_length("value")).cast("long").alias("bytes"))
