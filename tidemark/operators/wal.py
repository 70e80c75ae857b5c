"""Replay of log files with transaction frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_END = 9223372036854775807


def _framed(log: DataFrame) -> DataFrame:
    """Rows of (fid, offset, kind, ts) with the first bad offset of the file and whether the row's frame is finished.

    A frame is the run of rows up to a finishing one. A row is bad if a transaction's row
    differs from the frame's first timestamp, a finishing row from it, or a plain row lies
    inside an open frame. A file is bounded by its size limit, and so is its window.
    """
    order = Window.partitionBy("fid").orderBy("offset")
    frame = F.coalesce(F.sum((F.col("kind") == "F").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.withColumn("_frame", frame)
    opened = F.first(F.when(F.col("kind") == "T", F.col("ts")), ignorenulls=True).over(Window.partitionBy("fid", "_frame").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_open", opened)
    bad = F.when(F.col("kind") == "T", F.col("ts") != F.col("_open")).when(F.col("kind") == "F", F.col("ts") != F.coalesce("_open", F.lit(0))).otherwise(F.col("_open").isNotNull())
    first_bad = F.coalesce(F.min(F.when(bad, F.col("offset"))).over(Window.partitionBy("fid")), F.lit(_END))
    rows = rows.withColumn("_bad", first_bad)
    ended = F.max(((F.col("kind") == "F") & (F.col("offset") < F.col("_bad"))).cast("int")).over(Window.partitionBy("fid", "_frame"))
    return rows.withColumn("_ended", ended)


def replay(log: DataFrame) -> DataFrame:
    """The rows that a replay gives: plain ones, and those of finished transactions, before the first bad row of their file.

    `log` has fid, offset, kind ('P' plain, 'T' of a transaction, 'F' finishing one) and ts
    (from 1 on). Finishing rows are never given; an unfinished last frame is dropped.
    """
    rows = _framed(log).where("offset < _bad and (kind = 'P' or (kind = 'T' and _ended = 1))")
    return rows.drop("_frame", "_open", "_bad", "_ended")


def valid_end(log: DataFrame, start: int = 20) -> DataFrame:
    """(fid, valid_end): where each file is valid up to: behind the last plain or finishing row before the first bad one."""
    ends = F.max(F.when((F.col("offset") < F.col("_bad")) & F.col("kind").isin("P", "F"), F.col("offset") + F.col("size")))
    return _framed(log).groupBy("fid").agg(F.coalesce(ends, F.lit(start)).cast("long").alias("valid_end"))


def truncated(log: DataFrame, start: int = 20) -> DataFrame:
    """The log without what lies behind each file's valid end."""
    return log.join(valid_end(log, start), "fid").where("offset < valid_end").drop("valid_end")


def memtable(log: DataFrame) -> DataFrame:
    """The last row of each (key, ts) that a replay gives, by place in the log."""
    last = Window.partitionBy("key", "ts").orderBy(F.desc("fid"), F.desc("offset"))
    return replay(log).withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
