"""Tables, manifests, logs and discard files written in binary form; `sources.binary` and `sources.files` read them.

A file's bytes are made by one task, as its size is bounded by the store's settings, and written
by it under a name of their own that is then changed to the file's: a task that runs again
writes the same file, and no reader sees half of one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import bloom_hash, crc32c_of, key_with_version, stored_value
from tidemark.operators.greedy import blocks as block_cuts
from tidemark.sources.files import FILE_HEAD, encoded

#: Bytes, at most, of a file that is put together here: a store's files stay below.
MOST_BYTES = 1 << 31


def varint(n: int) -> bytes:
    """A number at seven bits a byte, low ones first."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | bytes) -> bytes:
    """A field of a protocol buffer message; nothing for 0 or b''."""
    if not value:
        return b""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def summed(parts: list[bytes]) -> list[bytes]:
    """Of each part, all summed at once, the checksum message and its length."""
    messages = [field(2, int(crc)) for crc in crc32c_of(parts)]
    return [m + struct.pack(">I", len(m)) for m in messages]


def bloom_bits(hashes: np.ndarray, rate: float) -> bytes:
    """A filter's bytes: bits of all keys by their hashes, then the number of probes; nothing for a rate of 0."""
    if rate <= 0 or not len(hashes):
        return b""
    per_key = math.ceil(-math.log(rate) / math.log(2))
    probes = min(30, max(1, int(per_key * 0.69)))
    n = (max(len(hashes) * per_key, 64) + 7) // 8 * 8
    h = hashes.astype(np.uint64)
    turned = (h >> np.uint64(17) | h << np.uint64(15)) & np.uint64(0xFFFFFFFF)
    bits = np.zeros(n, np.uint8)
    for _ in range(probes):
        bits[(h % np.uint64(n)).astype(np.int64)] = 1
        h = (h + turned) & np.uint64(0xFFFFFFFF)
    return np.packbits(bits, bitorder="little").tobytes() + bytes([probes])


class _Buffer:
    """A flat buffer laid out front to back: every offset points ahead."""

    def __init__(self) -> None:
        self.data = bytearray(4)

    def aligned(self, size: int, shift: int = 0) -> int:
        while (len(self.data) + shift) % size:
            self.data.append(0)
        return len(self.data)

    def table(self, fields: list[tuple[str, int]]) -> tuple[int, list[int]]:
        """A shape and a table of (form, value) fields, and where the fields are; an offset ('I' of -1) is set later."""
        places, end = [], 4
        for form, _ in fields:
            size = struct.calcsize(f"<{form}")
            end += -end % size
            places.append(end)
            end += size
        shape = self.aligned(8, 4 + 2 * len(fields))
        self.data += struct.pack(f"<{2 + len(fields)}H", 4 + 2 * len(fields), end, *places)
        at = len(self.data)
        self.data += struct.pack("<i", at - shape) + bytes(end - 4)
        for place, (form, value) in zip(places, fields):
            if value >= 0:
                struct.pack_into(f"<{form}", self.data, at + place, value)
        return at, [at + p for p in places]

    def point(self, place: int) -> int:
        """Lets an offset point to what comes next."""
        at = self.aligned(4)
        struct.pack_into("<I", self.data, place, at - place)
        return at

    def vector(self, place: int, data: bytes) -> None:
        self.point(place)
        self.data += struct.pack("<I", len(data)) + data


def table_index(first_keys: list[tuple[bytes, int, int]], bloom: bytes, max_version: int, key_count: int, on_disk_size: int) -> bytes:
    """A table's index as a flat buffer: (first key, offset, length) of each block, the filter and the table's figures."""
    out = _Buffer()
    at, places = out.table([("I", -1), ("I", -1), ("Q", max_version), ("I", key_count), ("I", 0), ("I", on_disk_size), ("I", 0)])
    struct.pack_into("<I", out.data, 0, at)
    vector = out.point(places[0])
    out.data += struct.pack("<I", len(first_keys)) + bytes(4 * len(first_keys))
    for i, (key, offset, length) in enumerate(first_keys):
        slot = vector + 4 + 4 * i
        at, own = out.table([("I", -1), ("I", offset), ("I", length)])
        struct.pack_into("<I", out.data, slot, at - slot)
        out.vector(own[0], key)
    out.vector(places[1], bloom)
    return bytes(out.data)


class TableBuilder:
    """The bytes of one table file, entry by entry in order."""

    def __init__(self, block_size: int, rate: float):
        self.step, self.rate = block_cuts(block_size), rate
        self.state: tuple | None = None
        self.parts: list[bytes] = []
        self.starts: list[int] = []
        self.base = b""
        self.blocks: list[tuple[bytes, bytes]] = []
        self.hashes: list[int] = []
        self.max_version = 0

    def add(self, key: bytes, stored: bytes, key_hash: int) -> None:
        self.state, (_, base, shared, _, begins) = self.step(self.state, (key, len(stored)))
        if not begins:
            self._close()
            self.base = base
        self.starts.append(begins)
        self.parts += struct.pack("<HH", shared, len(key) - shared), key[shared:], stored
        self.hashes.append(key_hash)
        self.max_version = max(self.max_version, ~int.from_bytes(key[-8:], "big") & 0xFFFFFFFFFFFFFFFF)

    def _close(self) -> None:
        if self.starts:
            data = b"".join([*self.parts, struct.pack(f">{len(self.starts) + 1}I", *self.starts, len(self.starts))])
            self.blocks.append((self.base, data))
            self.parts, self.starts = [], []

    def content(self) -> bytes:
        """All blocks, the index and its checksum; nothing without entries."""
        self._close()
        if not self.blocks:
            return b""
        first, at, blocks = [], 0, []
        for (key, data), checksum in zip(self.blocks, summed([data for _, data in self.blocks])):
            blocks += data, checksum
            first.append((key, at, len(data) + len(checksum)))
            at += first[-1][2]
        index = table_index(first, bloom_bits(np.array(self.hashes, np.int64), self.rate), self.max_version, len(self.hashes), at)
        return b"".join([*blocks, index, struct.pack(">I", len(index)), *summed([index])])


def _streamed(rows: DataFrame, group: str, order: list[str | Column], columns: list[str], begin, add, end) -> DataFrame:
    """(group, content): the bytes that each group's rows give in order, streamed: no more is held than they make."""
    sorted_rows = rows.repartition(group).sortWithinPartitions(group, *order).select(group, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, builder = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([end(builder)], pa.binary())], ["fid", "content"])

        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if builder is None or g != last:
                    if builder is not None:
                        yield made()
                    last, builder = g, begin()
                add(builder, *row)
        if builder is not None:
            yield made()

    return sorted_rows.mapInArrow(run, "fid long, content binary")


def table_files(log: DataFrame, block_size: int = 4096, rate: float = 0.01) -> DataFrame:
    """(fid, content): a table file for each table_id of (table_id, user_key, version, seq, value, meta, user_meta, expires_at).

    Entries are in order of key and newest version. Rows of no table are left out.
    """
    rows = log.where("table_id is not null").select(
        "table_id", "user_key", "version", "seq",
        key_with_version(F.col("user_key"), F.col("version")).alias("key"),
        stored_value(F.col("meta"), F.col("user_meta"), F.col("expires_at"), F.col("value")).alias("stored"),
        bloom_hash(F.col("user_key")).alias("hash"),
    )
    return _streamed(rows, "table_id", ["user_key", F.desc("version"), "seq"], ["key", "stored", "hash"], lambda: TableBuilder(block_size, rate), TableBuilder.add, TableBuilder.content)


def log_files(frames: DataFrame) -> DataFrame:
    """(fid, content): log or value files of (fid, offset, user_key, version, value, meta, user_meta, expires_at), entries in order of offset.

    A head of FILE_HEAD zero bytes (no encryption key), then each entry with its checksum.
    """
    return _streamed(encoded(frames), "fid", ["offset"], ["entry"], lambda: bytearray(FILE_HEAD), bytearray.extend, bytes)


def manifest_file(sets: Iterable[Iterable[tuple[str, int, int, int, int]]], magic: bytes, version: int, external: int = 0) -> bytes:
    """A manifest of sets of (op, table id, level, key id, compression) changes."""
    out = magic + struct.pack(">HH", external, version)
    for changes in sets:
        body = b"".join(field(1, field(1, table) + field(2, int(op == "DELETE")) + field(3, level) + field(4, key) + field(6, compression)) for op, table, level, key, compression in changes)
        out += struct.pack(">II", len(body), int(crc32c_of([body])[0])) + body
    return out


def manifest_files(changes: DataFrame, magic: bytes, version: int, external: int = 0) -> DataFrame:
    """(fid, content): the one manifest of (seq, op, table_id, level, key_id, compression) changes in order, a set each.

    A manifest is one file, bounded by rewriting it: a snapshot of the tables takes its place.
    """
    rows = changes.select(
        F.lit(0).cast("long").alias("fid"), "seq", "op", "table_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("level", "key_id", "compression")]
    )
    return _streamed(rows, "fid", ["seq"], ["op", "table_id", "level", "key_id", "compression"], list, lambda held, *row: held.append([row]), lambda held: manifest_file(held, magic, version, external))


def discard_files(stats: DataFrame, slots: int = 0) -> DataFrame:
    """(fid, content): the one discard file of (fid, discarded), by file id, filled up with empty slots."""
    rows = stats.select(F.lit(0).cast("long").alias("one"), F.col("fid").alias("file"), "discarded")

    def end(held: list[bytes]) -> bytes:
        return b"".join(held) + bytes(16 * max(1, slots - len(held)))

    return _streamed(rows, "one", ["file"], ["file", "discarded"], list, lambda held, fid, n: held.append(struct.pack(">QQ", fid, n)), end)


def write_files(files: DataFrame, folder: str, name: str) -> int:
    """Writes (fid, content) as files of a folder and gives their number. `name` has the id's place, as in {:05d}.sst.

    Empty contents make no file. `folder` is a path, or a URI that Arrow's file systems know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(path)
        for batch in batches:
            lengths = []
            for fid, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content and len(content) >= MOST_BYTES:
                    raise ValueError(f"file {fid} has {len(content)} bytes")
                if content:
                    half = f"{path}/.{uuid4().hex}"
                    with system.open_output_stream(half) as out:
                        out.write(content)
                    system.move(half, f"{path}/{name.format(fid)}")
                    lengths.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n"])

    return files.select("fid", "content").mapInArrow(run, "n long").count()
