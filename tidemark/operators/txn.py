"""Transactions: checks of writes, sizes, conflicts, commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import counted_bytes, too_long
from tidemark.operators import ranges
from tidemark.sources.tables import partitions

#: Bytes that a transaction counts before its first write and beside each.
START, EACH = 21, 10
MAX_KEY = 65_000


def last_pending(writes: DataFrame, txn: str = "txn") -> DataFrame:
    """The last write of each (transaction, key) by seq."""
    last = Window.partitionBy(txn, "user_key").orderBy(F.desc("seq"))
    return writes.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def checked(writes: DataFrame, reserved: bytes, max_value: int, read_only: bool = False, discarded: bool = False) -> DataFrame:
    """`writes` with `status`, the first rule that each breaks, and `message` for what is too long.

    In order: ReadOnlyTxn, DiscardedTxn, EmptyKey (null or empty), InvalidKey (reserved
    prefix), KeyTooLong, ValueTooLong, else Ok. A null value is empty.
    """
    key, value = F.col("user_key"), F.coalesce("value", F.lit(b""))
    long_key, long_value = F.octet_length(key) > MAX_KEY, F.octet_length(value) > max_value
    status = (
        F.when(F.lit(read_only), "ReadOnlyTxn")
        .when(F.lit(discarded), "DiscardedTxn")
        .when(key.isNull() | (F.octet_length(key) == 0), "EmptyKey")
        .when(F.startswith(key, F.lit(reserved)), "InvalidKey")
        .when(long_key, "KeyTooLong")
        .when(long_value, "ValueTooLong")
        .otherwise("Ok")
    )
    message = F.when(F.col("status") == "KeyTooLong", too_long("Key", key, MAX_KEY)).when(F.col("status") == "ValueTooLong", too_long("Value", value, max_value))
    return writes.withColumn("status", status).withColumn("message", message)


def banned(writes: DataFrame, offset: int, namespaces: list[int]) -> DataFrame:
    """`writes` with `banned`: whether the eight bytes of the key at `offset` name a banned namespace.

    A negative offset bans nothing, nor does a key of at most offset + 8 bytes. The set is
    a literal in the filter.
    """
    if offset < 0 or not namespaces:
        return writes.withColumn("banned", F.lit(False))
    names = [F.lit(n.to_bytes(8, "big")) for n in namespaces]
    hit = (F.octet_length("user_key") > offset + 8) & F.substr(F.col("user_key"), F.lit(offset + 1), F.lit(8)).isin(names)
    return writes.withColumn("banned", F.coalesce(hit, F.lit(False)))


def sizes(writes: DataFrame, threshold: int, limit: int, txn: str = "txn", length: Column | None = None) -> DataFrame:
    """`writes`, with a value or its `length`, with `size`, the bytes of the transaction with this write, and `too_big`, whether that reaches the limit.

    A write that overwrites an earlier one counts again. A transaction is bounded by its
    limit, so its window is too.
    """
    order = Window.partitionBy(txn).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    size = F.lit(START) + F.sum(counted_bytes(F.col("user_key"), F.octet_length("value") if length is None else length, threshold) + EACH).over(order)
    return writes.withColumn("size", size.cast("long")).withColumn("too_big", F.col("size") >= limit)


def too_big(sized: DataFrame, txn: str = "txn") -> DataFrame:
    """(txn, seq, size): the first write that each too big transaction fails at."""
    return sized.where("too_big").groupBy(txn).agg(F.min(F.struct("seq", "size")).alias("w")).select(txn, "w.seq", "w.size")


def conflicts(writes: DataFrame, reads: DataFrame, spans: int | None = None) -> DataFrame:
    """(txn, n, first_ts): transactions that must abort, the number of commits that got between and the first of them.

    `writes` has (user_key, commit_ts); `reads` (txn, user_key, read_ts, commit_ts). A read
    conflicts with a commit of the same key with read_ts < commit_ts of the write <
    commit_ts of the reader; keys are compared, not hashes. Rows with nulls don't count.

    No pair is made: the commits of a key behind each of the reader's two timestamps are
    counted, and the difference is the answer; the first one is the next behind the reading.
    One sort from the latest to the earliest within (key, one of `spans` ranges of
    timestamps that hold about equal numbers of commits) gives both, so a hot key is
    spread; what a key's later ranges hold comes from one row each.
    """
    commits = writes.where("user_key is not null and commit_ts is not null").select("user_key", F.col("commit_ts").alias("ts"))
    at = ranges.bounds(commits, ["ts"], min(spans or 4 * partitions(writes.sparkSession), ranges.MOST_RANGES))
    asked = reads.where("txn is not null and user_key is not null and read_ts is not null and commit_ts is not null").select("txn", "user_key", "read_ts", "commit_ts").distinct()
    # at one timestamp, from the last: the start of a read, a commit, the end of a read
    marks = F.array(F.struct(F.col("read_ts").alias("ts"), F.lit(2).alias("kind")), F.struct(F.col("commit_ts").alias("ts"), F.lit(0).alias("kind")))
    read = asked.select("user_key", "txn", F.col("commit_ts").alias("end"), F.inline(marks))
    rows = commits.distinct().withColumn("kind", F.lit(1)).unionByName(read, allowMissingColumns=True).withColumn("_slot", ranges.part_of(at, ["ts"], commits))
    one, commit = (F.col("kind") == 1).cast("long"), F.when(F.col("kind") == 1, F.col("ts"))
    down = Window.partitionBy("user_key", "_slot").orderBy(F.desc("ts"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("user_key").orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("user_key", "_slot").agg(F.sum(one).alias("_n"), F.min(commit).alias("_first"))
    slots = slots.select("user_key", "_slot", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_more"), F.last("_first", ignorenulls=True).over(later).alias("_later"))
    counted = rows.withColumn("_here", F.sum(one).over(down)).withColumn("_next", F.last(commit, ignorenulls=True).over(down)).where("kind <> 1").join(slots, ["user_key", "_slot"])
    start, behind = F.col("kind") == 2, F.col("_here") + F.col("_more")
    following = F.coalesce("_next", "_later")
    found = counted.groupBy("txn").agg(
        F.sum(F.when(start, behind).otherwise(-behind)).alias("n"), F.min(F.when(start & (following < F.col("end")), following)).alias("first_ts")
    )
    return found.where("n > 0")


def committed(writes: DataFrame, aborted: DataFrame, next_ts: int, txn: str = "txn") -> DataFrame:
    """The writes of transactions that don't abort, under new versions from `next_ts` on in order of transaction.

    The number of a transaction is its rank among those that commit, by range partitions.
    """
    going = writes.select(txn).where(F.col(txn).isNotNull()).distinct().join(aborted.select(txn).distinct(), txn, "left_anti")
    numbers = ranges.numbered(going, [txn], "commit_ts", next_ts, of=writes)
    return last_pending(writes, txn).join(numbers, txn)
