"""Keys, sizes, hashes and checksums of log entries as column functions.

Versions are longs from 0 on. An internal key is the user key and the eight big-endian
bytes of the inverted version, so that of one key the newest sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Bits of an entry's meta byte.
DELETE, VALUE_POINTER, DISCARD_EARLIER, MERGE_ENTRY, TXN, FIN_TXN = 1, 2, 4, 8, 64, 128
# Bytes of a checksum, of a value pointer, of the longest header.
CRC_BYTES, POINTER_BYTES, MAX_HEADER = 4, 12, 22


def has(meta: Column | str, bit: int) -> Column:
    """Whether a bit is set; a null meta has none."""
    meta = F.col(meta) if isinstance(meta, str) else meta
    return F.coalesce(meta.bitwiseAND(bit) != 0, F.lit(False))


def key_with_version(key: Column, version: Column) -> Column:
    """The internal key, binary; null if either is null."""
    return F.concat(key, F.unhex(F.lpad(F.hex(F.bitwise_not(version)), 16, "0")))


def user_key(internal: Column) -> Column:
    """An internal key without its version; a key shorter than eight bytes has none left."""
    return F.substr(internal, F.lit(1), F.greatest(F.octet_length(internal) - 8, F.lit(0)))


def version_of(internal: Column) -> Column:
    """The version of an internal key; 0 if it is shorter than eight bytes."""
    tail = F.hex(F.substr(internal, F.octet_length(internal) - 7, F.lit(8)))
    return F.when(F.octet_length(internal) < 8, F.lit(0).cast("long")).otherwise(F.bitwise_not(F.conv(tail, 16, -10).cast("long")))


def varint_bytes(x: Column) -> Column:
    """Bytes that a number takes at seven bits a byte: one for 0, ten for a negative long."""
    return F.when(x < 0, F.lit(10)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int"))


def varint(x: Column) -> Column:
    """The number itself at seven bits a byte, low ones first, binary."""
    last = varint_bytes(x) - 1
    parts = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", x, i * 7).bitwiseAND(127).bitwiseOR(F.when(i < last, 128).otherwise(0))), 2, "0"),
    )
    return F.unhex(F.array_join(parts, ""))


def byte(x: Column) -> Column:
    """One byte, binary."""
    return F.unhex(F.lpad(F.hex(x.bitwiseAND(255).cast("long")), 2, "0"))


def header_bytes(key: Column, value: Column, expires_at: Column) -> Column:
    """Length of an entry's header: two meta bytes and three varints."""
    return F.lit(2) + varint_bytes(F.octet_length(key).cast("long")) + varint_bytes(F.octet_length(value).cast("long")) + varint_bytes(expires_at)


def entry_bytes(key: Column, value: Column, expires_at: Column) -> Column:
    """Length of an encoded entry: header, key, value, checksum."""
    return header_bytes(key, value, expires_at) + F.octet_length(key) + F.octet_length(value) + CRC_BYTES


def entry_head(meta: Column, user_meta: Column, key: Column, value: Column, expires_at: Column) -> Column:
    """The header of an entry, binary."""
    return F.concat(byte(meta), byte(user_meta), varint(F.octet_length(key).cast("long")), varint(F.octet_length(value).cast("long")), varint(expires_at))


def value_bytes(value: Column, expires_at: Column) -> Column:
    """Length of a stored value: two meta bytes, the expiry as a varint, the value."""
    return stored_bytes(F.octet_length(value), expires_at)


def stored_bytes(length: Column, expires_at: Column) -> Column:
    """The same for a value of a known length."""
    return length + 2 + varint_bytes(expires_at)


def stored_value(meta: Column, user_meta: Column, expires_at: Column, value: Column) -> Column:
    """A stored value, binary."""
    return F.concat(byte(meta), byte(user_meta), varint(expires_at), value)


def unstored_value(data: Column) -> Column:
    """struct(meta, user_meta, expires_at, value) of a stored value; user_meta is the second byte."""

    def at(i: Column) -> Column:
        return F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long")

    ends = F.filter(F.sequence(F.lit(3), F.least(F.octet_length(data), F.lit(12))), lambda i: at(i) < 128)
    end = F.try_element_at(ends, F.lit(1))
    expiry = F.aggregate(F.sequence(F.lit(3), end), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", at(i).bitwiseAND(127), (i - 3) * 7)))
    return F.struct(
        at(F.lit(1)).cast("int").alias("meta"),
        at(F.lit(2)).cast("int").alias("user_meta"),
        expiry.alias("expires_at"),
        F.substr(data, end + 1, F.octet_length(data)).alias("value"),
    )


def estimated_bytes(key: Column, value: Column, threshold: int) -> Column:
    """What an entry counts for in a transaction: its value if below the threshold, else a pointer."""
    return counted_bytes(key, F.octet_length(value), threshold)


def counted_bytes(key: Column, length: Column, threshold: int) -> Column:
    """The same for a value of a known length."""
    return F.octet_length(key) + 2 + F.when(length < threshold, length).otherwise(POINTER_BYTES)


def number(data: Column, first: int, n: int) -> Column:
    """n big-endian bytes from position `first` (from 1) as a long; n is at most 7."""
    return F.conv(F.hex(F.substr(data, F.lit(first), F.lit(n))), 16, 10).cast("long")


def file_id(path: Column, suffix: str) -> Column:
    """The id in a file's name, such as 7 of 00007.sst; null if the name isn't digits and the suffix, or 0."""
    digits = F.regexp_extract(path, rf"(?:^|/)(\d+){suffix.replace('.', chr(92) + '.')}$", 1)
    return F.when(F.length(digits) > 0, F.nullif(digits.cast("long"), F.lit(0)))


def file_name(ident: Column, suffix: str) -> Column:
    """The name of a file by its id, five digits at least."""
    return F.format_string(f"%05d{suffix}", ident)


def too_long(prefix: str, data: Column, limit: int) -> Column:
    """The message about a key or value above its limit, with at most a KB of it, or a fixed text if that is no UTF-8."""
    head = F.substr(data, F.lit(1), F.lit(1024)).cast("string")
    shown = F.when(F.is_valid_utf8(head), head).otherwise("(convert bytes to string failed)")
    return F.format_string(f"{prefix} with size %d exceeded {limit} limit. {prefix}:\n%s", F.octet_length(data), shown)


def common_prefix(key: Column, base: Column) -> Column:
    """Length of the longest common prefix of two binaries."""
    both = F.least(F.octet_length(key), F.octet_length(base))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: (i > both) | (F.substr(key, i, F.lit(1)) != F.substr(base, i, F.lit(1))))
    return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, both)


def overlap(key: Column, base: Column) -> Column:
    """Bytes of a block's first key that a key leaves out: nothing if one is a prefix of the other."""
    n = common_prefix(key, base)
    return F.when(n < F.least(F.octet_length(key), F.octet_length(base)), n).otherwise(0)


def restored_key(base: Column, shared: Column, rest: Column) -> Column:
    """A key from the bytes it shares with the block's first key and the rest."""
    return F.concat(F.substr(base, F.lit(1), shared), rest)


def key_fingerprint(key: Column) -> Column:
    """A 64-bit hash of a key; only equality means anything."""
    return F.xxhash64(key)


# Seed and multiplier of the filter's hash.
BLOOM_SEED, BLOOM_MULTIPLIER = 0xBC9F1D34, 0xC6A4A793
_LOW = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bloom_hashes_of(values: list[bytes | None]) -> np.ndarray:
    """The filter's 32-bit hashes of many keys at once, as longs: four bytes a round, low one first, over all keys that
    reach it, then what is left of each."""
    lengths = np.array([len(v) if v else 0 for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(v or b"" for v in values) + bytes(4), np.uint8).astype(np.uint32)
    n = lengths[order]
    at = (np.cumsum(lengths) - lengths)[order]
    multiplier = np.uint32(BLOOM_MULTIPLIER)
    h = np.uint32(BLOOM_SEED) ^ (n.astype(np.uint32) * multiplier)

    def word(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        return sum((np.where(i < count, data[np.minimum(begin + i, len(data) - 1)], 0).astype(np.uint32) << np.uint32(8 * i) for i in range(4)), np.zeros(len(begin), np.uint32))

    for t in range(int(n[0]) // 4 if len(n) else 0):
        k = int(np.searchsorted(-n, -4 * (t + 1), side="right"))
        x = (h[:k] + word(at[:k] + 4 * t, np.full(k, 4))) * multiplier
        h[:k] = x ^ (x >> np.uint32(16))
    left = n % 4
    x = (h + word(at + n - left, left)) * multiplier
    h = np.where(left > 0, x ^ (x >> np.uint32(24)), h)
    out = np.empty(len(values), np.int64)
    out[order] = h
    return out


@F.pandas_udf(LongType())
def bloom_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The filter's 32-bit hash of a key, as a long; null for null."""
    for values in batches:
        yield pd.Series(bloom_hashes_of(list(values)), index=values.index, dtype="Int64").mask(values.isna())


def bloom_bits_per_key(n: Column, rate: float) -> Column:
    """Bits a key for a wanted rate of false positives."""
    ln2 = 0.69314718056
    size = -n.cast("double") * F.log(F.lit(rate)) / ln2**2
    return F.ceil(ln2 * size / n).cast("int")


def bloom_probes(bits_per_key: Column) -> Column:
    """Bits set for a key: 1 to 30."""
    return F.least(F.lit(30), F.greatest(F.lit(1), F.floor(bits_per_key * 0.69))).cast("int")


def bloom_size(n: Column, bits_per_key: Column) -> Column:
    """Bits of a filter: at least 64, whole bytes."""
    return (F.floor((F.greatest(n * bits_per_key, F.lit(64)) + 7) / 8) * 8).cast("long")


def bloom_positions(h: Column, probes: Column, bits: Column) -> Column:
    """The bits that a hash sets: each step adds the hash rotated by 17."""
    delta = (F.call_function("shiftright", h, F.lit(17)).bitwiseOR(F.call_function("shiftleft", h, F.lit(15)))).bitwiseAND(F.lit(_LOW))
    return F.transform(F.sequence(F.lit(0), probes - 1), lambda i: (h + delta * i).bitwiseAND(F.lit(_LOW)) % bits)


def _crc_table() -> np.ndarray:
    # Fixed value: the reversed Castagnoli polynomial.
    polynomial = np.uint32(0x82F63B78)
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ polynomial, out >> np.uint32(1))
    return out.astype(np.uint32)


#: Bytes whose checksums are taken side by side before they are put together.
CRC_PIECE = 64


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of a step of one byte, and four tables, one a byte of the state, of a step over CRC_PIECE zero bytes."""
    table = _crc_table()
    state = np.array([byte << shift for shift in (0, 8, 16, 24) for byte in range(256)], np.uint32)
    for _ in range(CRC_PIECE):
        state = table[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    return table, state.reshape(4, 256)


def crc32c_of(values: list[bytes | None]) -> np.ndarray:
    """CRC32C of many byte strings at once.

    A checksum is linear: the sums of all pieces of CRC_PIECE bytes, of all strings, are
    taken together, byte by byte; then each string's are put together, piece by piece, and
    the bytes left over follow.
    """
    table, over = _crc_tables()
    lengths = np.array([len(v) if v else 0 for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(v or b"" for v in values), np.uint8)
    starts, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    pieces = n // CRC_PIECE
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts - first * CRC_PIECE, pieces) + np.arange(int(pieces.sum())) * CRC_PIECE
    sums = np.zeros(len(at), np.uint32)

    def step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return table[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))

    for i in range(CRC_PIECE if len(at) else 0):
        sums = step(sums, data[at + i])
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for j in range(int(pieces[0]) if len(pieces) else 0):
        k = int(np.searchsorted(-pieces, -j, side="left"))
        c = crc[:k]
        moved = over[0][c & np.uint32(0xFF)] ^ over[1][(c >> np.uint32(8)) & np.uint32(0xFF)] ^ over[2][(c >> np.uint32(16)) & np.uint32(0xFF)] ^ over[3][c >> np.uint32(24)]
        crc[:k] = moved ^ sums[first[:k] + j]
    left = n % CRC_PIECE
    for i in range(int(left.max()) if len(left) else 0):
        own = np.flatnonzero(left > i)
        crc[own] = step(crc[own], data[starts[own] + pieces[own] * CRC_PIECE + i])
    out = np.empty(len(values), np.int64)
    out[order] = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


@F.pandas_udf(LongType())
def crc32c(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC32C (Castagnoli) of binary values as a long; null for null. Spark's crc32 is another polynomial."""
    for values in batches:
        sums = pd.Series(crc32c_of(list(values)), index=values.index, dtype="Int64")
        yield sums.mask(values.isna())
