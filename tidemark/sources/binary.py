"""Tables, manifests and discard files in binary form.

Each file is read whole by one task (its size is bounded by the store's settings) and gives
rows as it is walked. All numbers are big-endian but those of entry headers and of the
index, which are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import crc32c_of, file_id
from tidemark.sources.files import _varint

TABLE = "table_id long, block long, key binary, version long, meta int, user_meta int, expires_at long, value binary"
INDEX = "table_id long, block long, first_key binary, offset long, len long, max_version long, key_count long, on_disk_size long, bloom binary"
CHANGE = "change_set long, number long, op string, table_id long, level int, key_id long, compression int"
DISCARD = "fid long, discarded long"


class Broken(ValueError):
    """A file that isn't what it should be."""


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message: numbers and byte strings."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if at < 0:
            raise Broken("a message is cut off")
        value, at = _varint(data, at)
        if at < 0:
            raise Broken("a message is cut off")
        if tag & 7 == 2:
            if at + value > len(data):
                raise Broken("a message is cut off")
            yield tag >> 3, bytes(data[at : at + value])
            at += value
        elif tag & 7 == 0:
            yield tag >> 3, value
        else:
            raise Broken(f"wire type {tag & 7}")


def _compare(crc: int, checksum: bytes, what: str) -> None:
    fields = dict(message(checksum))
    if fields.get(1, 0) != 0:
        raise Broken(f"{what}: unknown kind of checksum")
    if crc != fields.get(2, 0):
        raise Broken(f"{what}: wrong checksum")


def _check(data: bytes, checksum: bytes, what: str) -> None:
    _compare(int(crc32c_of([data])[0]), checksum, what)


class _Flat:
    """A table of a flat buffer: its fields by number."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.shape = at - struct.unpack_from("<i", data, at)[0]

    def _field(self, number: int) -> int | None:
        size = struct.unpack_from("<H", self.data, self.shape)[0]
        slot = 4 + 2 * number
        offset = struct.unpack_from("<H", self.data, self.shape + slot)[0] if slot < size else 0
        return self.at + offset if offset else None

    def number(self, number: int, form: str) -> int:
        at = self._field(number)
        return 0 if at is None else struct.unpack_from(form, self.data, at)[0]

    def vector(self, number: int) -> tuple[int, int]:
        """Number of elements, and where the first is."""
        at = self._field(number)
        if at is None:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return struct.unpack_from("<I", self.data, at)[0], at + 4

    def bytes(self, number: int) -> bytes:
        n, at = self.vector(number)
        return bytes(self.data[at : at + n])

    def tables(self, number: int) -> Iterator[_Flat]:
        n, at = self.vector(number)
        for i in range(n):
            place = at + 4 * i
            yield _Flat(self.data, place + struct.unpack_from("<I", self.data, place)[0])


def table_index(content: bytes) -> dict:
    """A table file's index: blocks as (first key, offset, length), sizes, filter. Its checksum is compared."""
    if len(content) < 8:
        raise Broken("a table is cut off")
    (n,) = struct.unpack_from(">I", content, len(content) - 4)
    at = len(content) - 4 - n
    if at < 4:
        raise Broken("a table is cut off")
    (size,) = struct.unpack_from(">I", content, at - 4)
    index = content[at - 4 - size : at - 4]
    if len(index) != size:
        raise Broken("a table is cut off")
    _check(index, content[at : at + n], "index")
    root = _Flat(index, struct.unpack_from("<I", index, 0)[0])
    return {
        "blocks": [(b.bytes(0), b.number(1, "<I"), b.number(2, "<I")) for b in root.tables(0)],
        "bloom": root.bytes(1),
        "max_version": root.number(2, "<Q"),
        "key_count": root.number(3, "<I"),
        "on_disk_size": root.number(5, "<I"),
    }


def _block_end(data: bytes) -> tuple[int, bytes]:
    """Where a block's checksum begins, and the checksum."""
    n = struct.unpack_from(">I", data, len(data) - 4)[0] if len(data) >= 12 else len(data)
    if n + 12 > len(data):
        raise Broken("a block is cut off")
    return len(data) - 4 - n, data[len(data) - 4 - n : len(data) - 4]


def block_entries(data: bytes, verify: bool = True) -> Iterator[tuple[bytes, bytes]]:
    """(internal key, stored value) of a block's entries in order."""
    end, checksum = _block_end(data)
    if verify:
        _check(data[:end], checksum, "block")
    (count,) = struct.unpack_from(">I", data, end - 4)
    last = end - 4 - 4 * count
    starts = [*struct.unpack_from(f">{count}I", data, last), last]
    base = b""
    for at, stop in zip(starts, starts[1:]):
        shared, rest = struct.unpack_from("<HH", data, at)
        key = base[:shared] + data[at + 4 : at + 4 + rest]
        base = base or key
        yield key, data[at + 4 + rest : stop]


def _long(n: int) -> int:
    """A number as a long; what is beyond is the highest."""
    return min(n, (1 << 63) - 1)


def verify_blocks(content: bytes) -> None:
    """Compares the checksums of all blocks of a table file, summed together."""
    blocks = [content[offset : offset + length] for _, offset, length in table_index(content)["blocks"]]
    ends = [_block_end(b) for b in blocks]
    for crc, (_, checksum) in zip(crc32c_of([b[:end] for b, (end, _) in zip(blocks, ends)]), ends):
        _compare(int(crc), checksum, "block")


def table_rows(content: bytes, verify: bool = True) -> Iterator[tuple]:
    """(block, key, version, meta, user_meta, expires_at, value) of all entries of a table file."""
    if verify:
        verify_blocks(content)
    for number, (_, offset, length) in enumerate(table_index(content)["blocks"]):
        for internal, stored in block_entries(content[offset : offset + length], False):
            expires_at, at = _varint(stored, 2)
            version = ~int.from_bytes(internal[-8:], "big") & 0xFFFFFFFFFFFFFFFF if len(internal) >= 8 else 0
            yield number, internal[:-8], _long(version), stored[0], stored[1], _long(expires_at), stored[at:]


def _read(spark: SparkSession, folder: str, pattern: str, suffix: str | None, schema: str, walk: Callable[[int, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of the files of a folder, 4096 at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    ident = F.lit(0).cast("long") if suffix is None else file_id(F.col("path"), suffix)
    files = files.select(ident.alias("fid"), "content").where("fid is not null")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fid, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                for row in walk(fid, content):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], arrow.names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], arrow.names)

    return files.mapInArrow(run, schema)


def read_tables(spark: SparkSession, folder: str, suffix: str = ".sst", verify_blocks: bool = False) -> DataFrame:
    """The entries of a folder's table files (columns of TABLE). The index's checksum is always compared, the blocks' if asked."""
    return _read(spark, folder, f"*{suffix}", suffix, TABLE, lambda fid, data: ((fid, *row) for row in table_rows(data, verify_blocks)))


def verify_tables(spark: SparkSession, folder: str, mode: str, suffix: str = ".sst") -> DataFrame:
    """(table_id, fault): each table that a mode looks at, and what is wrong with it, null if nothing.

    none: no table is looked at. table: blocks are compared as a table is opened. block: as
    they are read. both: each time. The faults of one file are the same either way; a file
    with a broken index is a fault in each mode but none.
    """
    if mode not in ("none", "table", "block", "both"):
        raise ValueError(f"mode {mode}")

    def walk(fid: int, data: bytes) -> Iterator[tuple]:
        fault = None
        try:
            for _ in range(2 if mode == "both" else 1):
                verify_blocks(data)
        except Broken as e:
            fault = str(e)
        yield fid, fault

    found = _read(spark, folder, f"*{suffix}", suffix, "table_id long, fault string", walk)
    return found.limit(0) if mode == "none" else found


def read_indexes(spark: SparkSession, folder: str, suffix: str = ".sst") -> DataFrame:
    """One row for each block of a folder's table files (columns of INDEX)."""

    def walk(fid: int, data: bytes) -> Iterator[tuple]:
        index = table_index(data)
        for number, (key, offset, length) in enumerate(index["blocks"]):
            yield fid, number, key, offset, length, _long(index["max_version"]), index["key_count"], index["on_disk_size"], index["bloom"]

    return _read(spark, folder, f"*{suffix}", suffix, INDEX, walk)


def change_sets(content: bytes, magic: bytes, version: int, external: int = 0) -> Iterator[tuple]:
    """(set, number, op, table id, level, key id, compression) of a manifest file's changes. A cut-off last set is left out; one
    longer than the whole file is an error."""
    if content[: len(magic)] != magic:
        raise Broken("manifest: wrong magic")
    found_external, found = struct.unpack_from(">HH", content, len(magic))
    if found_external != external:
        raise Broken(f"manifest: external magic {found_external}, not {external}")
    if found != version:
        raise Broken(f"manifest: version {found}, not {version}")
    at, number = len(magic) + 4, 0
    while at + 8 <= len(content):
        size, checksum = struct.unpack_from(">II", content, at)
        if size > len(content):
            raise Broken(f"manifest: a set of {size} bytes in a file of {len(content)}")
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            return
        if int(crc32c_of([body])[0]) != checksum:
            raise Broken("manifest: wrong checksum")
        for i, (_, change) in enumerate(message(body)):
            fields = dict(message(change))
            yield number, i, "DELETE" if fields.get(2, 0) else "CREATE", fields.get(1, 0), fields.get(3, 0), fields.get(4, 0), fields.get(6, 0)
        at, number = at + 8 + size, number + 1


def read_manifest(spark: SparkSession, folder: str, magic: bytes, version: int, external: int = 0, name: str = "MANIFEST") -> DataFrame:
    """The changes of a manifest file (columns of CHANGE); `magic` and `version` are those of the store's format."""
    return _read(spark, folder, name, None, CHANGE, lambda _, data: change_sets(data, magic, version, external))


def read_discards(spark: SparkSession, folder: str, name: str = "DISCARD") -> DataFrame:
    """(fid, discarded) of a discard file: slots of two numbers, up to the first of file 0."""

    def walk(_: int, data: bytes) -> Iterator[tuple]:
        for fid, discarded in struct.iter_unpack(">QQ", data[: len(data) // 16 * 16]):
            if not fid:
                return
            yield _long(fid), _long(discarded)

    return _read(spark, folder, name, None, DISCARD, walk)
