"""Reads of a multi-version log at a snapshot.

A log has user_key, version, seq and any other columns. Of the writes of a key under one
version the last written, by seq, counts. All results are defined for empty logs: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import DELETE, DISCARD_EARLIER, has
from tidemark.operators.ranges import MOST_RANGES, bounds, part_of
from tidemark.sources.tables import partitions


def read_version(log: DataFrame) -> DataFrame:
    """One row: the version that a new transaction reads at, the highest committed (0 for an empty log)."""
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("read_ts"))


def invisible(now: int, meta: str = "meta", expires_at: str = "expires_at") -> Column:
    """Deleted, or expired at `now` (epoch seconds; an expiry of 0 is none, equality is expired)."""
    return has(meta, DELETE) | ((F.col(expires_at) != 0) & (F.col(expires_at) <= now))


def newest(log: DataFrame, read_ts: int | None = None, n: int = 1) -> DataFrame:
    """The n newest writes of each key up to a version, tombstones included.

    Spark limits each key's rows before the shuffle and after it, so a key of any size
    reaches its task as n rows a partition.
    """
    rows = log if read_ts is None else log.where(F.col("version") <= read_ts)
    last = Window.partitionBy("user_key").orderBy(F.desc("version"), F.desc("seq"))
    return rows.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= n).drop("_rank")


def snapshot(log: DataFrame, now: int, read_ts: int | None = None) -> DataFrame:
    """Each key's visible newest write; a deleted or expired newest one hides all before it."""
    return newest(log, read_ts).where(~invisible(now))


def get(log: DataFrame, key: bytes, now: int, read_ts: int | None = None) -> DataFrame:
    """The value of one key, or no row. The key reaches the scan as a filter."""
    return snapshot(log.where(F.col("user_key") == F.lit(key)), now, read_ts)


def multi_get(log: DataFrame, keys: DataFrame, now: int, read_ts: int | None = None) -> DataFrame:
    """(user_key, status, version, value): what each distinct wanted key gives: found, deleted, expired or absent.

    Null and empty keys are not wanted. The log is reduced to newest writes before the join.
    """
    wanted = keys.where(F.col("user_key").isNotNull() & (F.octet_length("user_key") > 0)).select("user_key").distinct()
    found = newest(log, read_ts).select("user_key", "version", "value", "meta", "expires_at")
    status = F.when(F.col("version").isNull(), "absent").when(has("meta", DELETE), "deleted").when(invisible(now), "expired").otherwise("found")
    rows = wanted.join(found, "user_key", "left").withColumn("status", status)
    return rows.select("user_key", "status", "version", F.when(F.col("status") == "found", F.col("value")).alias("value"))


def history(log: DataFrame, prefix: bytes, now: int) -> DataFrame:
    """All versions of the keys that begin with a prefix, and whether each would be visible were it the newest."""
    rows = log.where(F.startswith(F.col("user_key"), F.lit(prefix)))
    return rows.withColumn("live", ~invisible(now))


def overlay(stored: DataFrame, pending: DataFrame, now: int, read_ts: int) -> DataFrame:
    """(user_key, version, value): a snapshot as a transaction sees it that has pending writes of its own.

    A pending write wins, deleted or expired ones hide the key, and it shows the reading
    version as its own. `pending` has at most one row a key (see `last_pending`).
    """
    old = stored.where(F.col("version") <= read_ts).select("user_key", "version", "seq", "value", "meta", "expires_at", F.lit(0).alias("_own"))
    own = pending.select("user_key", F.lit(read_ts).cast("long").alias("version"), F.lit(None).cast("long").alias("seq"), "value", "meta", "expires_at", F.lit(1).alias("_own"))
    last = Window.partitionBy("user_key").orderBy(F.desc("_own"), F.desc("version"), F.desc("seq"))
    rows = old.unionByName(own).withColumn("_rank", F.row_number().over(last)).where("_rank = 1")
    return rows.where(~invisible(now)).select("user_key", "version", "value")


def as_of(probes: DataFrame, log: DataFrame, spans: int | None = None) -> DataFrame:
    """(probe, user_key, found_version): for each (probe, user_key, version) the newest version of the key up to it; null if none.

    A key's rows are spread over `spans` ranges of versions, which hold about equal numbers
    of the log's rows however its versions are spaced, so no key has more than a range's
    share in one; a probe that finds nothing in its own takes the last version of an earlier one.
    """
    at = bounds(log, ["version"], min(spans or 4 * partitions(log.sparkSession), MOST_RANGES))
    marks = log.select("user_key", "version", F.lit(None).cast("long").alias("probe")).distinct()
    rows = marks.unionByName(probes.select("user_key", "version", F.col("probe").cast("long").alias("probe"))).withColumn("_range", part_of(at, ["version"], log))
    own = F.when(F.col("probe").isNull(), F.col("version"))
    order = Window.partitionBy("user_key", "_range").orderBy("version", F.col("probe").asc_nulls_first())
    here = rows.withColumn("_here", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("user_key", "_range").agg(F.max(own).alias("_end"))
    before = Window.partitionBy("user_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("user_key", "_range", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    found = here.where("probe is not null").join(carry, ["user_key", "_range"], "left")
    return found.select("probe", "user_key", F.coalesce("_here", "_before").alias("found_version"))


def retained(log: DataFrame, n: int, now: int) -> DataFrame:
    """What compaction keeps: each key's n newest writes, of those the unexpired ones, tombstones included."""
    return newest(log, None, n).where(~((F.col("expires_at") != 0) & (F.col("expires_at") <= now)))


def compacted_to_bottom(log: DataFrame, now: int) -> DataFrame:
    """Compaction to the lowest level: only visible newest writes stay, tombstones have nothing left to hide."""
    return snapshot(log, now)


def without_discarded(log: DataFrame) -> DataFrame:
    """The log without what a later write of the same key discarded by its bit for earlier versions.

    Cuts are few rows, one for each key that has such a write; AQE splits a hot key's rows
    in the join.
    """
    cuts = log.where(has("meta", DISCARD_EARLIER)).groupBy("user_key").agg(F.max("version").alias("_cut"))
    return log.join(cuts, "user_key", "left").where(F.col("_cut").isNull() | (F.col("version") >= F.col("_cut"))).drop("_cut")


def merged(log: DataFrame, fold: dict[str, Column], now: int) -> DataFrame:
    """Each key's unexpired, undeleted writes folded into one row by aggregates that combine in any order.

    `fold` names them; partial results meet before the shuffle, so no key's writes are gathered.
    """
    return log.where(~invisible(now)).groupBy("user_key").agg(*[c.alias(name) for name, c in fold.items()])


#: Rows that are folded together at once by `merged_in_order`.
FOLDED = 1000


def merged_in_order(log: DataFrame, element: Column, combine: Callable[[Column, Column], Column], now: int, spans: int | None = None) -> DataFrame:
    """(user_key, merged): each key's unexpired, undeleted writes folded from the oldest to the newest.

    `element` is a write's operand, `combine(a, b)` of two neighbouring ones is theirs; it
    must be associative, not commutative. A tree of folds: a key's rows within one of
    `spans` ranges of versions, FOLDED at a time, then FOLDED of these, and so on, then the
    ranges. No key's writes are gathered, whatever their number.
    """
    at = bounds(log, ["version"], min(spans or 4 * partitions(log.sparkSession), MOST_RANGES))
    rows = log.where(~invisible(now)).select("user_key", part_of(at, ["version"], log).alias("_span"), "version", "seq", element.alias("_e"))
    place = F.row_number().over(Window.partitionBy("user_key", "_span").orderBy("version", "seq")) - 1
    level = rows.select("user_key", "_span", place.cast("long").alias("_at"), "_e")

    def folded(df: DataFrame, by: list[str]) -> DataFrame:
        row = F.array_sort(F.collect_list(F.struct("_at", "_e")))
        each = df.groupBy(*by).agg(row.alias("_r"))
        rest = F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0)))
        return each.withColumn("_e", F.aggregate(rest, F.element_at("_r", 1)["_e"], lambda a, x: combine(a, x["_e"]))).drop("_r")

    for _ in range(2):
        chunks = level.withColumn("_few", F.floor(F.col("_at") / FOLDED))
        level = folded(chunks, ["user_key", "_span", "_few"]).withColumnRenamed("_few", "_at")
    whole = folded(level, ["user_key", "_span"]).withColumnRenamed("_span", "_at")
    return folded(whole, ["user_key"]).withColumnRenamed("_e", "merged")


def expiry_days(log: DataFrame) -> DataFrame:
    """(day, n): writes by the day (UTC) they expire on; those that never do are left out."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("expires_at") / 86_400).cast("int"))
    return log.where("expires_at <> 0").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
