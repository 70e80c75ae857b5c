"""Queries that write the store's binary files into the shared folder and read them back, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, messages
from tidemark.operators import checksums, manifest, vlog, wal
from tidemark.plans.store import (
    _BLOCKS, _DISCARD, _HASHED, _MANIFEST, _REPLAYED, FILE_BYTES, FILE_ENTRIES, LOG, NOW, TEXT_THRESHOLD, THRESHOLD, _discards, _documents, _frames, _LIVE, _newest,
)
from tidemark.options import Options
from tidemark.sources import binary, files, writing
from tidemark.sources.log import entry_log
from tidemark.sources.tables import shared_folder, table
from tidemark.store import Store
from tidemark.streaming import feed

#: The four bytes that a manifest of these queries begins with, and its version: parameters of a store's format.
MAGIC, VERSION = b"tide", 8
PREFIX, IGNORED = b"cfg.????.", "4-7"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{kind}-{uuid4().hex}"


def _tables(spark: SparkSession, folder: str) -> str:
    """Writes the flushed entries as table files."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "user_meta", "expires_at", "table_id")
    place = _folder(spark, "tables")
    writing.write_files(writing.table_files(log), place, "{:05d}.sst")
    return place


@query(
    f"""{_BLOCKS} select f.table_id, f.block::bigint as block, decode(l.user_key) as user_key, l.version, l.meta, l.user_meta, l.expires_at, hex(l.value) as value
from f join log l on l.seq = f.seq"""
)
def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of table files that were written, read back with all checksums compared."""
    rows = binary.read_tables(spark, _tables(spark, folder), verify_blocks=True)
    return rows.select("table_id", "block", F.col("key").cast("string").alias("user_key"), "version", "meta", "user_meta", "expires_at", F.hex("value").alias("value"))


@query(
    f"""{_BLOCKS}, t as (select table_id, max(version) as max_version, count(*) as key_count from log where table_id is not null group by table_id)
select f.table_id, f.block::bigint as block, min(base) as first_key, max_version, key_count from f join t using (table_id) group by all"""
)
def table_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """The indexes of table files that were written."""
    rows = binary.read_indexes(spark, _tables(spark, folder))
    return rows.select("table_id", "block", F.hex("first_key").alias("first_key"), "max_version", "key_count")


@query(f"{_HASHED} select table_id, (bit // 8)::bigint as byte, sum(1::bigint << (bit % 8)::int)::int as mask from b group by 1, 2")
def table_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes that are not 0 of the filters in table files that were written, their number of probes left out."""
    rows = binary.read_indexes(spark, _tables(spark, folder)).where("block = 0")
    last = F.octet_length("bloom") - 1
    byte = F.explode(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.cast("long").alias("byte"), F.conv(F.hex(F.substr("bloom", i + 1, F.lit(1))), 16, 10).cast("int").alias("mask"))))
    return rows.select("table_id", byte.alias("b")).select("table_id", "b.*").where("mask <> 0")


@query(f"{LOG} select mode, count(distinct table_id) filter (mode <> 'none') as tables, 0 as broken from log, (values ('none'), ('table'), ('block'), ('both')) m(mode) where table_id is not null group by mode")
def table_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Tables looked at and broken ones, by what is verified when a table is opened and its blocks are read."""
    place = _tables(spark, folder)
    out = None
    for mode in checksums.MODES:
        found = binary.verify_tables(spark, place, mode)
        row = found.agg(F.lit(mode).alias("mode"), F.count("*").alias("tables"), F.count_if(F.col("fault").isNotNull()).alias("broken"))
        out = row if out is None else out.unionByName(row)
    return out


@query(_REPLAYED)
def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a replay of log files gives that were written with their frames and read back."""
    place = _folder(spark, "log")
    writing.write_files(writing.log_files(_frames(spark, folder)), place, "{:05d}.mem")
    frames = files.framed(files.read_log_files(spark, place)).withColumn("key", F.col("key").cast("string"))
    return wal.replay(frames).select("fid", "offset", "key", "ts")


@query(f"{_REPLAYED.replace('select fid, off as \"offset\", key, ts from e', 'select fid, true as here, count(*) as n from e')} group by fid")
def log_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The log files of a folder by id with the number of entries that each still has; other files are left out."""
    place = _folder(spark, "log")
    writing.write_files(writing.log_files(wal.replay(_frames(spark, folder)).withColumn("meta", F.lit(0))), place, "{:05d}.mem")
    writing.write_files(spark.createDataFrame([(0, b"x"), (1, b"y")], "fid long, content binary"), place, "{:d}.tmp")
    n = files.read_log_files(spark, place).groupBy("fid").agg(F.count("*").alias("n"))
    return files.listed(spark, place, ".mem").join(n, "fid").select("fid", (F.col("length") > 20).alias("here"), "n")


@query(f"{_MANIFEST} select table_id, coalesce(level, 0) as level, coalesce(key_id, 0) as key_id from m")
def manifest_file(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of a manifest file, one set of changes after the other, that was written and replayed."""
    return _replayed(spark, _manifest_rows(spark, folder)).select("table_id", "level", "key_id")


def _manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = manifest.changes(table(spark, folder, "manifest_log"))
    return rows.select("seq", F.when(F.col("created"), "CREATE").otherwise("DELETE").alias("op"), "table_id", "level", "key_id", F.lit(0).alias("compression"))


def _replayed(spark: SparkSession, changes: DataFrame) -> DataFrame:
    place = _folder(spark, "manifest")
    writing.write_files(writing.manifest_files(changes, MAGIC, VERSION), place, "MANIFEST")
    log = binary.read_manifest(spark, place, MAGIC, VERSION)
    return manifest.state(log.select((F.col("change_set") * 1_000_000 + F.col("number")).alias("seq"), "op", "table_id", "level", "key_id"))


@query(f"{_MANIFEST} select (select count(*) from c) as changes, count(*) as tables, count(*) as rewritten, coalesce(sum(coalesce(level, 0)), 0)::bigint as levels from m")
def manifest_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of a manifest, the tables they leave, and changes and levels after it was rewritten as a snapshot of these."""
    rows = _manifest_rows(spark, folder)
    state = _replayed(spark, rows)
    snapshot = state.select(F.col("table_id").alias("seq"), F.lit("CREATE").alias("op"), "table_id", "level", "key_id", F.lit(0).alias("compression"))
    again = _replayed(spark, snapshot)
    counts = (rows.agg(F.count("*").alias("changes")), state.agg(F.count("*").alias("tables")), again.agg(F.count("*").alias("rewritten"), F.coalesce(F.sum("level"), F.lit(0)).alias("levels")))
    one = [c.withColumn("_one", F.lit(1)) for c in counts]
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")


@query(f"{_DISCARD} select fid, discarded from s where fid > 0")
def discard_file(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes to discard in each file, from a discard file that was written."""
    place = _folder(spark, "discard")
    writing.write_files(writing.discard_files(_discards(spark, folder).where("fid > 0"), 1024), place, "DISCARD")
    return binary.read_discards(spark, place)


@query(f"select doc_id as seq, md5(text) as value from documents where doc_id is not null and coalesce(strlen(text), 0) >= {TEXT_THRESHOLD}")
def vlog_files(spark: SparkSession, folder: str) -> DataFrame:
    """Large values read back by file and offset from value log files that were written."""
    place = _folder(spark, "vlog")
    docs = _documents(spark, folder).withColumns({"user_key": codec.key_with_version(F.col("user_key"), F.col("seq")), "user_meta": F.lit(0)})
    # the files of all writers in one folder: a hundred documents make less than a hundred files
    own = (F.col("writer") * 100 + F.col("fid")).alias("fid")
    written = vlog.write(docs, TEXT_THRESHOLD, FILE_BYTES, FILE_ENTRIES).withColumns({"fid": own, "version": F.col("seq"), "user_key": codec.user_key(F.col("user_key"))})
    writing.write_files(writing.log_files(written), place, "{:09d}.vlog")
    found = files.read_log_files(spark, place, ".vlog").select("fid", "offset", "value")
    return vlog.places(docs, TEXT_THRESHOLD, FILE_BYTES, FILE_ENTRIES).withColumn("fid", own).join(found, ["fid", "offset"]).select("seq", F.md5("value").alias("value"))


@query(
    f"""{LOG} select seq, hex(user_key) || printf('%016X', (18446744073709551615::ubigint - version::ubigint)) as key, hex(value) as value, meta % 256 as meta, user_meta % 256 as user_meta, expires_at,
printf('%05d.mem', fid) as file, fid as file_id, true as ok from log"""
)
def entry_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Entries encoded, checked and decoded again, beside the name of their file and the id read off it."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "user_meta", "expires_at", "fid")
    out = files.verified(files.encoded(log)).select("seq", "fid", "ok", files.taken_apart("entry").alias("e"))
    name = codec.file_name(F.col("fid"), ".mem")
    return out.select("seq", F.hex("e.key").alias("key"), F.hex("e.value").alias("value"), "e.meta", "e.user_meta", "e.expires_at", name.alias("file"), codec.file_id(name, ".mem").alias("file_id"), "ok")


@query(f"{LOG} select decode(user_key) as user_key, version, hex(value) as value from ({_newest()}) where {_LIVE}")
def store_levels(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of a store that took the log in three segments, flushed them, merged its levels and was opened again."""
    place = _folder(spark, "store")
    log = entry_log(spark, folder)
    with Store.open(spark, Options(place, num_level_zero_tables=2)) as store:
        for part in range(3):
            store.ingest(log.where(F.pmod("fid", F.lit(3)) == part), 0)
            store.flush()
        store.maintain(NOW)
    with Store.open(spark, Options(place)) as again:
        return again.snapshot(now=NOW).select(F.col("user_key").cast("string").alias("user_key"), "version", F.hex("value").alias("value"))


@query(f"{LOG} select seq, hex(value) as value from log")
def write_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The log's values after its writes went as batches through value log, room check and memtables, read back."""
    place = _folder(spark, "pipeline")
    log = entry_log(spark, folder, "fid", "seq", "user_key", "version", "value", "meta", "user_meta", "expires_at").withColumnRenamed("fid", "writer")
    log.repartitionByRange(3, "seq").write.parquet(f"{place}/requests")
    requests = feed.read_stream(spark, f"{place}/requests", log.schema, 1)
    options = Options(place, value_threshold=THRESHOLD, mem_table_size=1 << 16)
    feed.group_commit(requests, feed.apply_batch(f"{place}/out", options), f"{place}/state").awaitTermination()
    return feed.applied(spark, f"{place}/out").select("seq", F.hex("value").alias("value"))


_KV = """select distinct seq, hex(coalesce(key, ''::blob)) as key, hex(coalesce(value, ''::blob)) as value, hex(coalesce(user_meta, ''::blob)) as user_meta, coalesce(version, 0) as version,
coalesce(expires_at, 0) as expires_at, hex(coalesce(meta, ''::blob)) as meta, stream_id, coalesce(stream_done, false) as stream_done from kv_feed"""


@query(_KV)
def kv_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The feed's messages in wire form, and read from it again."""
    rows = table(spark, folder, "kv_feed").select("seq", messages.kv().alias("message")).distinct()
    kv = messages.read_kv(rows, "message")
    return kv.select("seq", F.hex("key").alias("key"), F.hex("value").alias("value"), F.hex("user_meta").alias("user_meta"), "version", "expires_at", F.hex("meta").alias("meta"), "stream_id", "stream_done")


@query(f"select distinct seq, decode(key) as key from kv_feed where octet_length(key) >= {len(PREFIX)} and seq is not null and substr(hex(key), 1, 8) = '{PREFIX[:4].hex().upper()}' and substr(hex(key), 17, 2) = '2E'")
def subscription(spark: SparkSession, folder: str) -> DataFrame:
    """Messages whose keys match a prefix but for some bytes that are ignored."""
    rows = table(spark, folder, "kv_feed", "seq", "key").where("seq is not null")
    return feed.matching(rows, [(PREFIX, IGNORED)], "key").distinct().withColumn("key", F.col("key").cast("string"))
