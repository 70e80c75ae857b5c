"""Has this key been seen before? A minimal perfect hash and fingerprints for each sealed partition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import key_fingerprint
from tidemark.sources.tables import has_key, shared_folder

#: Keys that a sealed partition holds on average; its index takes about 4.5 bytes a key.
KEYS_A_PARTITION = 200_000
LEVELS = 24
#: Hashes that are made distinct at once before the exchange.
WINDOW = 1 << 20
_INDEX = "part int, n long, levels binary, prints binary, rest binary"


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash for one level from a key's."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of n keys by their distinct 64-bit hashes, level by level: a key that meets no other on a
    level takes its bit there.

    The slot of a key is the number of bits set before its own. Hashes left after the last
    level are kept as they are. `prints` has 32 bits of each key at its slot.
    """

    def __init__(self, bits: list[np.ndarray], prints: np.ndarray, rest: np.ndarray):
        self.bits, self.prints, self.rest = bits, prints, rest
        self.before = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in bits]
        self.offset = np.concatenate([[0], np.cumsum([int(b.sum()) for b in bits], dtype=np.int64)])

    @classmethod
    def build(cls, h: np.ndarray, gamma: float = 2.0, levels: int = LEVELS) -> PerfectHash:
        prints = np.zeros(len(h), np.uint32)
        bits: list[np.ndarray] = []
        left, done = h, 0
        for level in range(levels):
            if not len(left):
                break
            size = max(8, int(gamma * len(left)))
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            slot = done + np.cumsum(alone)[at[own]] - 1
            prints[slot] = cls.fingerprint(left[own])
            bits.append(alone)
            done += int(alone.sum())
            left = left[~own]
        return cls(bits, prints[:done], left)

    @staticmethod
    def fingerprint(h: np.ndarray) -> np.ndarray:
        return (_mixed(h, 77) >> np.uint64(32)).astype(np.uint32)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for a key that certainly wasn't there."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, bits in enumerate(self.bits):
            if not len(left):
                break
            at = (_mixed(h[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.offset[level] + self.before[level][at[hit]]
            left = left[~hit]
        return out

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Whether each key may have been there: wrong for about 1 in 2^32 of those that were not."""
        slot = self.slots(h)
        hit = slot >= 0
        hit[hit] = self.prints[slot[hit]] == self.fingerprint(h[hit])
        return hit | np.isin(h, self.rest) if len(self.rest) else hit

    def dump(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(self.bits), *map(len, self.bits)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.bits), self.prints.tobytes(), self.rest.tobytes()

    @classmethod
    def load(cls, levels: bytes, prints: bytes, rest: bytes) -> PerfectHash:
        n = int(np.frombuffer(levels, np.int64, 1)[0])
        sizes = np.frombuffer(levels, np.int64, n, 8)
        at, bits = 8 * (n + 1), []
        for size in map(int, sizes):
            packed = np.frombuffer(levels, np.uint8, (size + 7) // 8, at)
            bits.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(bits, np.frombuffer(prints, np.uint32), np.frombuffer(rest, np.uint64))


def _hashes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return table.column("h").to_numpy().view(np.uint64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes, each once among WINDOW of them: a key on very many rows is few before the exchange."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["h"])

    for batch in batches:
        held.append(batch.column(0).to_numpy())
        if sum(map(len, held)) >= WINDOW:
            yield out()
            held.clear()
    if held:
        yield out()


def _sealed(table: pa.Table) -> pa.Table:
    """One row: the index of a partition's keys."""
    h = np.unique(_hashes(table))
    levels, prints, rest = PerfectHash.build(h).dump()
    row = {"part": [table.column("part")[0].as_py()], "n": [len(h)], "levels": [levels], "prints": [prints], "rest": [rest]}
    return pa.table(row, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("levels", pa.binary()), ("prints", pa.binary()), ("rest", pa.binary())]))


def _probed(keys: pa.Table, index: pa.Table) -> pa.Table:
    """(h, first_id, maybe) of incoming keys that meet the index of their partition, or none."""
    h = _hashes(keys)
    if index.num_rows and len(h):
        maybe = PerfectHash.load(*(index.column(c)[0].as_py() for c in ("levels", "prints", "rest"))).contains(h)
    else:
        maybe = np.zeros(len(h), bool)
    return pa.table({"h": keys.column("h"), "first_id": keys.column("first_id"), "maybe": pa.array(maybe)})


def _placed(hashes: DataFrame, parts: int) -> DataFrame:
    """`hashes` with the sealed partition that each belongs to."""
    return hashes.withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)).cast("int"))


class Sealed(NamedTuple):
    """The indexes of sealed partitions, a row each, and the number of partitions."""

    index: DataFrame
    parts: int


def seal(log: DataFrame, key: str = "user_key", keys_a_partition: int = KEYS_A_PARTITION, path: str | None = None) -> Sealed:
    """Seals all keys of a log and writes their indexes, to `path` or into the shared folder; null and empty keys are none.

    The number of partitions comes from the number of rows, so none grows with the log.
    Only hashes are exchanged, 8 bytes a key, made distinct before it: no hot key weighs
    more than another.
    """
    spark = log.sparkSession
    parts = max(1, math.ceil(log.count() / keys_a_partition))
    hashes = log.where(has_key(key)).select(key_fingerprint(F.col(key)).alias("h")).mapInArrow(_distinct, "h long")
    folder = path or f"{shared_folder(spark)}/sealed-{uuid4().hex}"
    _placed(hashes, parts).groupBy("part").applyInArrow(_sealed, _INDEX).write.parquet(folder)
    return Sealed(spark.read.schema(_INDEX).parquet(folder), parts)


def first_seen(sealed: Sealed, incoming: DataFrame, key: str = "user_key", ident: str = "incoming_id") -> DataFrame:
    """(h, first_id, maybe): each distinct incoming key by its hash, the smallest id it came with, and whether the
    fingerprints take it for one of the sealed keys. Records without key or id are left out.

    The current batch is an exact set, by key. A partition's index meets only the incoming
    keys of the same partition.
    """
    first = incoming.where(has_key(key) & F.col(ident).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(ident).alias("first_id"))
    probes = _placed(first.select(key_fingerprint(F.col("key")).alias("h"), "first_id"), sealed.parts)
    return probes.groupBy("part").cogroup(sealed.index.groupBy("part")).applyInArrow(_probed, "h long, first_id long, maybe boolean")


def repeated_records(log: DataFrame, incoming: DataFrame, key: str = "user_key", ident: str = "incoming_id", sealed: Sealed | None = None) -> DataFrame:
    """(ident): the incoming records whose key the log has or an earlier incoming record had.

    Tables with a filter, tables without, and memory are sealed alike: a key counts wherever
    it lies. All but the first record of each key that the fingerprints call new: those are
    taken out by id, which spreads evenly however often a key comes. A new key is taken for
    a known one in about 1 of 2^32 cases, plus the number of keys over 2^64 for equal hashes;
    a known key is never taken for new. `wrong_rate` measures it. With `sealed`, written by
    an earlier call, the log isn't read. Empty tables give no keys or none seen.
    """
    answers = first_seen(sealed or seal(log, key), incoming, key, ident)
    fresh = answers.where(~F.col("maybe")).select(F.col("first_id").alias(ident))
    ids = incoming.where(has_key(key) & F.col(ident).isNotNull()).select(ident).distinct()
    return ids.join(fresh, ident, "left_anti")


#: A list of tables up to this many rows (a long each) is broadcast; a longer one is shuffled.
BROADCAST_TABLES = 1_000_000


def known_keys(log: DataFrame, key: str, tables: DataFrame | None) -> DataFrame:
    """(key, sealed, open): each distinct key of the log; whether it lies in a table with a filter, and whether elsewhere.

    Without `tables` all keys are sealed. A table has a filter if a row of it says so;
    null, false or no row at all is none, whatever the sizes say. Rows of no table are in
    memory and have none either.
    """
    rows = log.where(has_key(key)).select(F.col(key).alias("key"), *([] if tables is None else ["table_id"]))
    if tables is None:
        return rows.distinct().select("key", F.lit(True).alias("sealed"), F.lit(False).alias("open"))
    filtered = tables.where("has_bloom_filter and table_id is not null").select("table_id").distinct().withColumn("_has", F.lit(True))
    filtered = F.broadcast(filtered) if tables.count() <= BROADCAST_TABLES else filtered
    # distinct first: a key of many rows meets the tables once for each of its tables
    placed = rows.distinct().join(filtered, "table_id", "left")
    return placed.groupBy("key").agg(F.bool_or(F.col("_has").isNotNull()).alias("sealed"), F.bool_or(F.col("_has").isNull()).alias("open"))


def seen_before(log: DataFrame, incoming: DataFrame, tables: DataFrame | None = None, key: str = "user_key", ident: str = "incoming_id", keys_a_partition: int = KEYS_A_PARTITION) -> DataFrame:
    """(key, first_id, maybe, sealed, seen): each distinct incoming key, the smallest id it came with, what the
    fingerprints say of it (`maybe`: in the log), whether it is in a table with a filter, and whether it is in the log at all.

    The exact answer beside that of the fingerprints, to measure them: what they take for
    seen is compared with the keys themselves. Null and empty keys are left out on both
    sides, and so are records without an id.
    """
    answers = first_seen(seal(log, key, keys_a_partition), incoming, key, ident)
    named = incoming.where(has_key(key) & F.col(ident).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(ident).alias("first_id"))
    answered = named.withColumn("h", key_fingerprint(F.col("key"))).join(answers, ["h", "first_id"])
    k = known_keys(log, key, tables).select(F.col("key").alias("_key"), F.col("sealed").alias("_sealed"))
    met = answered.join(k, (F.col("key") == F.col("_key")) & F.col("maybe"), "left")
    return met.select("key", "first_id", "maybe", F.coalesce("_sealed", F.lit(False)).alias("sealed"), F.col("_key").isNotNull().alias("seen"))


def wrong_rate(answers: DataFrame) -> DataFrame:
    """One row: distinct incoming keys, those that aren't in the log, wrong answers among them, their rate."""
    new, wrong = (~F.col("seen")).cast("long"), (F.col("maybe") & ~F.col("seen")).cast("long")
    total = answers.agg(F.count("*").alias("keys"), F.coalesce(F.sum(new), F.lit(0)).alias("new_keys"), F.coalesce(F.sum(wrong), F.lit(0)).alias("wrong"))
    return total.withColumn("wrong_rate", F.when(F.col("new_keys") > 0, F.col("wrong") / F.col("new_keys")).otherwise(F.lit(0.0)))
