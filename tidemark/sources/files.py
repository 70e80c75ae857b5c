"""Log files in binary form, their listing, and Parquet sinks for logs, tables and manifests."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.codec import CRC_BYTES, MAX_HEADER, crc32c, crc32c_of, entry_head, file_id, key_with_version, let

#: Fixed value: bytes before a log file's first entry.
FILE_HEAD = 20
MOST_KEY = 1 << 16
ENTRY = "path string, fid long, offset long, len long, key binary, version long, value binary, meta int, user_meta int, expires_at long"
MANIFEST = "seq long, op string, table_id long, level int, key_id long, compression int, arrived_at timestamp_ntz"


def listed(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(fid, path, length): files of a folder named by an id and a suffix such as .mem, by id; others are left out.

    Contents aren't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(file_id(F.col("path"), suffix).alias("fid"), "path", "length").where("fid is not null").orderBy("fid")


def repeated_ids(files: DataFrame) -> DataFrame:
    """(fid, n): ids that more than one file has: an error on opening."""
    return files.groupBy("fid").agg(F.count("*").alias("n")).where("n > 1")


def encoded(log: DataFrame) -> DataFrame:
    """`log` with `entry`: header, internal key, value, and CRC32C of them, binary."""
    key = key_with_version(F.col("user_key"), F.col("version"))
    body = F.concat(entry_head(F.col("meta"), F.col("user_meta"), key, F.col("value"), F.col("expires_at")), key, "value")
    return log.withColumn("_body", body).withColumn("entry", F.concat("_body", F.unhex(F.lpad(F.hex(crc32c("_body")), 8, "0")))).drop("_body")


def verified(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """`entries` with `crc`, the checksum that an encoded entry's last four bytes state, and `ok`, whether what stands
    before them gives it; null and false for fewer bytes than that."""
    n = F.octet_length(entry)
    stated = F.when(n >= CRC_BYTES, F.conv(F.hex(F.substr(entry, n - (CRC_BYTES - 1), F.lit(CRC_BYTES))), 16, 10).cast("long"))
    found = crc32c(F.substr(entry, F.lit(1), F.greatest(n - CRC_BYTES, F.lit(0))))
    return entries.withColumn("crc", stated).withColumn("ok", F.coalesce(F.col("crc") == found, F.lit(False)))


def taken_apart(entry: str) -> Column:
    """struct(key, value, meta, user_meta, expires_at) of an encoded entry, its internal key as it is; columns alone."""

    def at(i: Column) -> Column:
        return F.conv(F.hex(F.substr(entry, i, F.lit(1))), 16, 10).cast("long")

    def number(begin: Column, end: Column) -> Column:
        return F.aggregate(F.sequence(begin, end), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", at(i).bitwiseAND(127), (i - begin) * 7)))

    # a header has three numbers, whose last bytes are below 128
    ends = F.slice(F.filter(F.sequence(F.lit(3), F.least(F.octet_length(entry), F.lit(MAX_HEADER))), lambda i: at(i) < 128), 1, 3)

    def body(e: Column) -> Column:
        n_key, n_value, last = number(F.lit(3), e[0]).cast("int"), number(e[0] + 1, e[1]).cast("int"), e[2]
        key, value = F.substr(entry, last + 1, n_key), F.substr(entry, last + 1 + n_key, n_value)
        return F.struct(key.alias("key"), value.alias("value"), at(F.lit(1)).cast("int").alias("meta"), at(F.lit(2)).cast("int").alias("user_meta"), number(e[1] + 1, last).alias("expires_at"))

    return let(ends, body)


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    """A number at `at` and where it ends; -1 if it doesn't."""
    value = shift = 0
    while at < len(data) and shift < 70:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at
    return 0, -1


#: Entries whose checksums are summed together.
TOGETHER = 4096


def _parsed(content: bytes, start: int) -> Iterator[tuple]:
    """(offset, end, key's begin, value's begin, meta, user_meta, expires_at) of entries by their headers alone."""
    data = memoryview(content)
    at = start
    while at + 2 < len(data):
        n_key, p = _varint(data, at + 2)
        n_value, p = _varint(data, p) if p >= 0 else (0, -1)
        expires_at, p = _varint(data, p) if p >= 0 else (0, -1)
        end = p + n_key + n_value
        if p < 0 or not 0 < n_key <= MOST_KEY or end + CRC_BYTES > len(data):
            return
        yield at, end, p, p + n_key, data[at], data[at + 1], expires_at
        at = end + CRC_BYTES


def decoded(content: bytes, start: int = FILE_HEAD) -> Iterator[tuple]:
    """(offset, len, key, version, value, meta, user_meta, expires_at) of each entry of a file, up to the first
    that is cut off, has a wrong checksum, a too long key or an empty one."""
    parsed = _parsed(content, start)
    while some := list(islice(parsed, TOGETHER)):
        sums = crc32c_of([content[at:end] for at, end, *_ in some])
        for (at, end, key_at, value_at, meta, user_meta, expires_at), crc in zip(some, sums):
            if int(crc) != int.from_bytes(content[end : end + CRC_BYTES], "big"):
                return
            key = content[key_at:value_at]
            version = ~int.from_bytes(key[-8:], "big") & 0xFFFFFFFFFFFFFFFF if len(key) >= 8 else 0
            yield at, end + CRC_BYTES - at, key[:-8] if len(key) >= 8 else b"", min(version, (1 << 63) - 1), content[value_at:end], meta, user_meta, min(expires_at, (1 << 63) - 1)


def read_log_files(spark: SparkSession, folder: str, suffix: str = ".mem") -> DataFrame:
    """The entries of a folder's binary log files, each file read by one task up to its first broken entry.

    Columns as in ENTRY. A file is bounded by the log's size limit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    files = files.select("path", file_id(F.col("path"), suffix).alias("fid"), "content").where("fid is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            for path, fid, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                for row in decoded(bytes(content)):
                    rows.append((path, fid, *row))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, ENTRY)


def framed(entries: DataFrame) -> DataFrame:
    """Entries of `read_log_files` as `operators.wal.replay` takes them: kind by bits, ts from key or value."""
    meta = F.col("meta")
    kind: Column = F.when(meta.bitwiseAND(128) != 0, "F").when(meta.bitwiseAND(64) != 0, "T").otherwise("P")
    stated = F.expr("try_cast(cast(value as string) as long)")
    return entries.withColumn("kind", kind).withColumn("ts", F.when(kind == "F", F.coalesce(stated, F.lit(-1))).otherwise(F.col("version"))).withColumnRenamed("len", "size")


def write_table(log: DataFrame, path: str, files: int, options: dict | None = None) -> None:
    """A new sorted table: range-partitioned and sorted by key and newest version, so that readers skip files
    and row groups; an error if it exists."""
    order = [F.col("user_key"), F.desc("version"), F.desc("seq")]
    writer = log.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("errorifexists")
    (writer.options(**options) if options else writer).option("parquet.bloom.filter.enabled#user_key", "true").parquet(path)


def append(log: DataFrame, path: str) -> None:
    """Rows appended to a log folder."""
    log.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    system, place = _at(spark, path)
    return system.exists(place)


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if it isn't there."""
    system, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()) if system.exists(place) else []


def length(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    system, place = _at(spark, path)
    return system.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all that is in it."""
    system, place = _at(spark, path)
    system.delete(place, True)


def open_or_create(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A Parquet log, made empty with a schema if it isn't there."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def publish_snapshot(state: DataFrame, folder: str, number: int) -> str:
    """A manifest snapshot in a folder of its own, then a row that points to it: readers see the old one or the new."""
    path = f"{folder}/snapshot-{number:06d}"
    state.write.mode("errorifexists").parquet(path)
    spark = state.sparkSession
    spark.createDataFrame([(number, path)], "number long, path string").coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return path


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest snapshot published last."""
    last = spark.read.parquet(f"{folder}/current").orderBy(F.desc("number")).limit(1).collect()
    return spark.read.parquet(last[0]["path"])
