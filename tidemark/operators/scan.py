"""Ordered scans and seeks. Keys ascend by their bytes, versions of a key descend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import MOST_RANGES, By, bounds, part_of
from tidemark.sources.tables import partitions


def scan(log: DataFrame, low: bytes | None = None, high: bytes | None = None, reverse: bool = False) -> DataFrame:
    """Entries with low <= key < high in order; both bounds reach the Parquet scan."""
    rows = log
    if low is not None:
        rows = rows.where(F.col("user_key") >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col("user_key") < F.lit(high))
    return rows.orderBy(F.desc("user_key"), "version") if reverse else rows.orderBy("user_key", F.desc("version"))


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with a prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix: bytes) -> DataFrame:
    """Entries whose keys begin with a prefix, in order, by a range the scan can skip files with."""
    return scan(log, prefix, prefix_end(prefix))


def last_entries(log: DataFrame, k: int) -> DataFrame:
    """The k last entries in order, last first: a distributed top-k."""
    return scan(log, reverse=True).limit(k)


def seek(log: DataFrame, key: bytes, version: int) -> DataFrame:
    """The first entry at or behind (key, version): at most one row."""
    return log.where((F.col("user_key") > F.lit(key)) | ((F.col("user_key") == F.lit(key)) & (F.col("version") <= version))).orderBy("user_key", F.desc("version")).limit(1)


def seek_for_prev(log: DataFrame, key: bytes, version: int) -> DataFrame:
    """The last entry at or before (key, version): at most one row."""
    return log.where((F.col("user_key") < F.lit(key)) | ((F.col("user_key") == F.lit(key)) & (F.col("version") >= version))).orderBy(F.desc("user_key"), "version").limit(1)


def ends(log: DataFrame) -> DataFrame:
    """One row: the first and last key with their versions; nulls for an empty log."""
    place = F.struct("user_key", (-F.col("version")).alias("v"))
    row = log.agg(F.min(place).alias("a"), F.max(place).alias("b"))
    return row.select(F.col("a.user_key").alias("first_key"), (-F.col("a.v")).alias("first_version"), F.col("b.user_key").alias("last_key"), (-F.col("b.v")).alias("last_version"))


def _sought(probes: DataFrame, log: DataFrame, forward: bool) -> DataFrame:
    order = ["user_key", By("version", True)]
    marks = log.select("user_key", "version").distinct()
    wanted = probes.select("user_key", "version", F.col("probe").cast("long").alias("probe"))
    # both are placed by the log's bounds, probes outside of it in its first or last range
    at = bounds(log, order, min(4 * partitions(log.sparkSession), MOST_RANGES))
    part = part_of(at, order, log)
    marks, wanted = (d.withColumn("_part", part) for d in (marks.withColumn("probe", F.lit(None).cast("long")), wanted))
    rows = marks.unionByName(wanted)
    place: Column = F.struct(F.col("user_key").alias("k"), F.col("version").alias("v"))
    own = F.when(F.col("probe").isNull(), place)
    ascending = [F.col("user_key"), F.desc("version")] if not forward else [F.desc("user_key"), F.col("version")]
    window = Window.partitionBy("_part").orderBy(*ascending, F.col("probe").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last(own, ignorenulls=True).over(window)).where("probe is not null")
    rank = F.struct(F.col("user_key").alias("k"), (-F.col("version")).alias("v"))
    edges = marks.groupBy("_part").agg((F.min if forward else F.max)(rank).alias("_edge"))
    # one row a range: a bounded table, so one task may order it
    parts = log.sparkSession.range(len(at) + 1).select(F.col("id").cast("int").alias("_part")).join(edges, "_part", "left")
    beyond = Window.partitionBy(F.lit(0)).orderBy(F.desc("_part") if forward else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_part", F.last("_edge", ignorenulls=True).over(beyond).alias("_beyond"))
    found = here.join(F.broadcast(carry), "_part", "left")
    return found.select(
        "probe",
        F.coalesce(F.col("_here.k"), F.col("_beyond.k")).alias("found_key"),
        F.coalesce(F.col("_here.v"), -F.col("_beyond.v")).alias("found_version"),
    )


def seek_many(probes: DataFrame, log: DataFrame) -> DataFrame:
    """(probe, found_key, found_version): for each (probe, user_key, version) the first entry at or behind it; nulls if none.

    Probes and entries are placed together in ranges of (key, version), so a hot key is
    split; within a range a running last value answers, across ranges a table of their
    first entries, one row each.
    """
    return _sought(probes, log, True)


def seek_many_for_prev(probes: DataFrame, log: DataFrame) -> DataFrame:
    """(probe, found_key, found_version): the last entry at or before each probe; nulls if none."""
    return _sought(probes, log, False)


def sources(*logs: DataFrame) -> DataFrame:
    """One log of several sources, such as memtables and tables: what a merging iterator would walk.

    Columns that a source lacks are null. The merge itself is the aggregate or window that
    reads it, so nothing is sorted for its own sake.
    """
    both = logs[0]
    for log in logs[1:]:
        both = both.unionByName(log, allowMissingColumns=True)
    return both
