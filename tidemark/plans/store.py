"""Queries of the versioned store's operators over the test tables, and their SQL.

Parameters stand here once, for both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import bloom, checksums, greedy, manifest, mvcc, ranges, scan, txn, vlog, wal, watermark
from tidemark.sources import files
from tidemark.sources.log import discard_log, entry_log, log_frames, mark_log
from tidemark.sources.tables import has_key, table

NOW = 1_750_000_000
READ_TS = 9_900_040_000
KEY = b"ctl/lease/primary"
PREFIX = b"cfg."
LOW, HIGH = b"idx.", b"q:"
THRESHOLD = 16
BATCH = 100_000
RESERVED = b"q:retry"
NAMESPACE = int.from_bytes(b"ctl/leas", "big")
WINDOW = 1000
SEGMENT = 16_384
FILE_BYTES, FILE_ENTRIES = 1 << 20, 1000
TEXT_THRESHOLD = 1024

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The writes of the log, each once, as `sources.log.entries` gives them.
LOG = """with log as (
  select user_key, version, coalesce(value, ''::blob) as value, coalesce(meta, 0) as meta, coalesce(user_meta, 0) as user_meta,
         coalesce(expires_at, 0) as expires_at, fid, log_offset, seq, table_id
  from (select *, row_number() over (partition by seq order by fid, log_offset) as copy from entry_log
        where octet_length(user_key) > 0 and version is not null and seq is not null) where copy = 1)"""
_VARINT = "case when {0} = 0 then 1 else (length(bin({0})) + 6) // 7 end"
_LIVE = f"(meta & 1) = 0 and (expires_at = 0 or expires_at > {NOW})"


def _newest(where: str = "true", n: int = 1) -> str:
    return f"select * from (select *, row_number() over (partition by user_key order by version desc, seq desc) as rn from log where {where}) where rn <= {n}"


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _text(name: str, alias: str | None = None):
    return F.col(name).cast("string").alias(alias or name)


# --- reads ------------------------------------------------------------------


@query(f"{LOG} select decode(user_key) as user_key, version, hex(value) as value, expires_at from ({_newest()}) where {_LIVE}")
def snapshot_latest(spark: SparkSession, folder: str) -> DataFrame:
    """All visible keys at the newest version."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "expires_at", once=False)
    return mvcc.snapshot(log, NOW).select(_text("user_key"), "version", F.hex("value").alias("value"), "expires_at")


@query(f"{LOG} select decode(user_key) as user_key, version, hex(value) as value, expires_at from ({_newest(f'version <= {READ_TS}')}) where {_LIVE}")
def snapshot_at_ts(spark: SparkSession, folder: str) -> DataFrame:
    """All visible keys as of a version."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "expires_at", once=False, where=F.col("version") <= READ_TS)
    return mvcc.snapshot(log, NOW, READ_TS).select(_text("user_key"), "version", F.hex("value").alias("value"), "expires_at")


@query(f"{LOG} select decode(user_key) as user_key, version, table_id is null as in_memory from ({_newest()}) where {_LIVE}")
def merge_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Visible entries of memory and tables together, in order, and where each was."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "meta", "expires_at", "table_id", once=False)
    both = scan.sources(log.where("table_id is null").drop("table_id").withColumn("in_memory", F.lit(True)), log.where("table_id is not null").withColumn("in_memory", F.lit(False)))
    return scan.scan(mvcc.snapshot(both, NOW)).select(_text("user_key"), "version", "in_memory")


@query(f"{LOG} select coalesce(max(version), 0)::bigint as read_ts from log")
def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The version a new transaction reads at."""
    return mvcc.read_version(entry_log(spark, folder, "version", once=False))


@query(f"{LOG} select decode(user_key) as user_key, version, hex(value) as value from ({_newest(f'''decode(user_key) = '{KEY.decode()}' ''')}) where {_LIVE}")
def point_get(spark: SparkSession, folder: str) -> DataFrame:
    """One key."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "expires_at", once=False, where=F.col("user_key") == F.lit(KEY))
    return mvcc.get(log, KEY, NOW).select(_text("user_key"), "version", F.hex("value").alias("value"))


_STATUS = f"case when n.version is null then 'absent' when (n.meta & 1) = 1 then 'deleted' when n.expires_at <> 0 and n.expires_at <= {NOW} then 'expired' else 'found' end"


@query(
    f"{LOG}, n as ({_newest()}), w as (select distinct user_key from incoming_keys where octet_length(user_key) > 0) "
    f"select decode(w.user_key) as user_key, {_STATUS} as status, coalesce(n.version, -1) as version, case when {_STATUS} = 'found' then hex(n.value) else '' end as value from w left join n using (user_key)"
)
def multi_get(spark: SparkSession, folder: str) -> DataFrame:
    """What each incoming key gives."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "expires_at", once=False)
    found = mvcc.multi_get(log, table(spark, folder, "incoming_keys", "user_key"), NOW)
    return found.select(_text("user_key"), "status", F.coalesce("version", F.lit(-1)).alias("version"), F.coalesce(F.hex("value"), F.lit("")).alias("value"))


@query(
    f"{LOG}, n as ({_newest()}), w as (select distinct user_key from incoming_keys where octet_length(user_key) > 0) "
    f"select {_STATUS} as status, count(*) as n from w left join n using (user_key) where {_STATUS} <> 'found' group by 1"
)
def get_missing_or_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """How many incoming keys give nothing, and why."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "expires_at", once=False)
    found = mvcc.multi_get(log, table(spark, folder, "incoming_keys", "user_key"), NOW)
    return found.where("status <> 'found'").groupBy("status").agg(F.count("*").alias("n"))


@query(f"{LOG} select decode(user_key) as user_key, version, seq, ({_LIVE}) as live from log")
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of all keys."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "meta", "expires_at")
    return mvcc.history(log, b"", NOW).select(_text("user_key"), "version", "seq", "live")


def _pending(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming records as one transaction's writes: every seventh deletes."""
    rows = table(spark, folder, "incoming_keys", "incoming_id", "user_key").where(has_key("user_key") & F.col("incoming_id").isNotNull())
    return rows.select(
        F.lit(1).alias("txn"),
        "user_key",
        F.col("incoming_id").alias("seq"),
        F.encode(F.col("incoming_id").cast("string"), "UTF-8").alias("value"),
        F.when(F.col("incoming_id") % 7 == 0, 1).otherwise(0).alias("meta"),
        F.lit(0).cast("long").alias("expires_at"),
    )


_PENDING = """(select user_key, max(incoming_id) as seq from incoming_keys where octet_length(user_key) > 0 and incoming_id is not null group by user_key)"""


@query(
    f"{LOG}, s as (select * from ({_newest(f'version <= {READ_TS}')}) where {_LIVE}), p as {_PENDING} "
    f"select decode(user_key) as user_key, {READ_TS}::bigint as version, hex(encode(seq::varchar)) as value from p where seq % 7 <> 0 "
    "union all select decode(user_key), version, hex(value) from s where user_key not in (select user_key from p)"
)
def overlay_read(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot with a transaction's own writes over it."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "expires_at", once=False, where=F.col("version") <= READ_TS)
    rows = mvcc.overlay(log, txn.last_pending(_pending(spark, folder)), NOW, READ_TS)
    return rows.select(_text("user_key"), "version", F.hex("value").alias("value"))


@query(
    f"{LOG}, p as (select distinct incoming_id as probe, user_key, coalesce(version, 0) - 30000000 as version from incoming_keys where octet_length(user_key) > 0 and incoming_id is not null) "
    "select p.probe, decode(p.user_key) as user_key, coalesce(max(l.version), -1) as found_version from p left join log l on l.user_key = p.user_key and l.version <= p.version group by 1, 2, p.version"
)
def asof_version_join(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of its key as of each incoming record."""
    probes = table(spark, folder, "incoming_keys", "incoming_id", "user_key", "version").where(has_key("user_key") & F.col("incoming_id").isNotNull()).distinct()
    probes = probes.select(F.col("incoming_id").alias("probe"), "user_key", (F.coalesce("version", F.lit(0)) - 30_000_000).alias("version"))
    return mvcc.as_of(probes, entry_log(spark, folder, "user_key", "version", once=False)).select("probe", _text("user_key"), F.coalesce("found_version", F.lit(-1)).alias("found_version"))


# --- scans --------------------------------------------------------------------


@query(f"{LOG} select decode(user_key) as user_key, version, seq from log where user_key >= '{LOW.decode()}'::blob and user_key < '{HIGH.decode()}'::blob")
def range_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Entries between two keys, in order."""
    return scan.scan(entry_log(spark, folder, "user_key", "version", "seq", where=(F.col("user_key") >= F.lit(LOW)) & (F.col("user_key") < F.lit(HIGH))), LOW, HIGH).select(_text("user_key"), "version", "seq")


@query(f"{LOG} select decode(user_key) as user_key, version, seq from log where starts_with(decode(user_key), '{PREFIX.decode()}')")
def prefix_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with a prefix, in order."""
    return scan.prefix_scan(entry_log(spark, folder, "user_key", "version", "seq", where=(F.col("user_key") >= F.lit(PREFIX)) & (F.col("user_key") < F.lit(scan.prefix_end(PREFIX)))), PREFIX).select(_text("user_key"), "version", "seq")


@query(f"{LOG} select decode(user_key) as user_key, version from (select distinct user_key, version from log order by user_key desc, version limit 100)")
def reverse_scan_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The last hundred places, last first."""
    return scan.last_entries(entry_log(spark, folder, "user_key", "version", once=False).distinct(), 100).select(_text("user_key"), "version")


@query(
    f"{LOG} select decode(min(user_key)) as first_key, max(version) filter (user_key = (select min(user_key) from log)) as first_version, "
    "decode(max(user_key)) as last_key, min(version) filter (user_key = (select max(user_key) from log)) as last_version from log"
)
def first_last_key(spark: SparkSession, folder: str) -> DataFrame:
    """The first and the last place."""
    return scan.ends(entry_log(spark, folder, "user_key", "version", once=False)).select(_text("first_key"), "first_version", _text("last_key"), "last_version")


def _probes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "incoming_keys", "incoming_id", "user_key").where(has_key("user_key") & F.col("incoming_id").isNotNull()).distinct()
    return rows.select(F.col("incoming_id").alias("probe"), "user_key", F.lit(READ_TS).cast("long").alias("version"))


_PLACES = f"""{LOG}, k as (select distinct user_key, version from log), e as (select user_key, max(version) as hi, min(version) as lo from k group by user_key),
p as (select distinct incoming_id as probe, user_key from incoming_keys where octet_length(user_key) > 0 and incoming_id is not null)"""


@query(
    f"""{_PLACES}, o as (select p.probe, max(k.version) as v from p join k on k.user_key = p.user_key and k.version <= {READ_TS} group by 1),
n as (select p.probe, p.user_key, e.user_key as k, e.hi from p asof left join e on e.user_key > p.user_key)
select n.probe, coalesce(decode(case when o.v is not null then n.user_key else n.k end), '') as found_key, coalesce(o.v, n.hi, -1) as found_version from n left join o using (probe)"""
)
def seek_ge_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The first place at or behind each incoming key at a version."""
    found = scan.seek_many(_probes(spark, folder), entry_log(spark, folder, "user_key", "version", once=False))
    return found.select("probe", F.coalesce(_text("found_key"), F.lit("")).alias("found_key"), F.coalesce("found_version", F.lit(-1)).alias("found_version"))


@query(
    f"""{_PLACES}, o as (select p.probe, min(k.version) as v from p join k on k.user_key = p.user_key and k.version >= {READ_TS} group by 1),
n as (select p.probe, p.user_key, e.user_key as k, e.lo from p asof left join e on e.user_key < p.user_key)
select n.probe, coalesce(decode(case when o.v is not null then n.user_key else n.k end), '') as found_key, coalesce(o.v, n.lo, -1) as found_version from n left join o using (probe)"""
)
def seek_le_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The last place at or before each incoming key at a version."""
    found = scan.seek_many_for_prev(_probes(spark, folder), entry_log(spark, folder, "user_key", "version", once=False))
    return found.select("probe", F.coalesce(_text("found_key"), F.lit("")).alias("found_key"), F.coalesce("found_version", F.lit(-1)).alias("found_version"))


# --- transactions ---------------------------------------------------------------


@query(f"{LOG} select version as txn, decode(user_key) as user_key, max(seq) as seq from log where (meta & 64) <> 0 group by version, user_key")
def pending_last_write(spark: SparkSession, folder: str) -> DataFrame:
    """The last write of each transaction to each key."""
    rows = entry_log(spark, folder, "user_key", "version", "seq", "meta", once=False).where(codec.has("meta", codec.TXN)).withColumnRenamed("version", "txn")
    return txn.last_pending(rows).select("txn", _text("user_key"), "seq")


_SIZED = f"""{LOG}, s as (select fid as txn, seq, 21 + sum(octet_length(user_key) + 2 + case when octet_length(value) < {THRESHOLD} then octet_length(value) else 12 end + 10)
  over (partition by fid order by seq rows unbounded preceding) as size from log)"""


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """Each log file's writes as one transaction."""
    return txn.sizes(entry_log(spark, folder, "user_key", "value_bytes", "seq", "fid").withColumnRenamed("fid", "txn"), THRESHOLD, BATCH, length=F.col("value_bytes"))


@query(f"{_SIZED} select txn, seq, size::bigint as size, size >= {BATCH} as too_big from s")
def txn_size_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each transaction after each write."""
    return _sized(spark, folder).select("txn", "seq", "size", "too_big")


@query(f"{_SIZED} select txn, min(seq) as seq, min(size)::bigint as size from s where size >= {BATCH} group by txn")
def txn_too_big(spark: SparkSession, folder: str) -> DataFrame:
    """Where each too big transaction fails."""
    return txn.too_big(_sized(spark, folder))


@query(
    f"""select distinct seq, case when coalesce(octet_length(user_key), 0) = 0 then 'EmptyKey' when starts_with(decode(user_key), '{RESERVED.decode()}') then 'InvalidKey'
  when octet_length(user_key) > 65000 then 'KeyTooLong' when coalesce(octet_length(value), 0) > 30 then 'ValueTooLong' else 'Ok' end as status,
  case when coalesce(octet_length(user_key), 0) > 0 and not starts_with(decode(user_key), '{RESERVED.decode()}') and octet_length(value) > 30
  then 'Value with size ' || octet_length(value) || ' exceeded 30 limit. Value:' || chr(10) || decode(value) end as message from entry_log where seq is not null"""
)
def key_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The rule that each write breaks."""
    rows = table(spark, folder, "entry_log", "seq", "user_key", "value").where("seq is not null")
    return txn.checked(rows, RESERVED, 30).select("seq", "status", "message").distinct()


@query(f"{LOG} select seq, octet_length(user_key) > 8 and starts_with(decode(user_key), '{NAMESPACE.to_bytes(8, 'big').decode()}') as banned from log")
def namespace_ban(spark: SparkSession, folder: str) -> DataFrame:
    """Writes to a banned namespace."""
    return txn.banned(entry_log(spark, folder, "user_key", "seq"), 0, [NAMESPACE]).select("seq", "banned")


_CONFLICT = f"""{LOG}, w as (select distinct user_key, version from log where (meta & 64) <> 0),
c as (select a.version as txn, b.user_key, b.version as other from w a join w b on a.user_key = b.user_key and b.version < a.version and b.version > a.version - {WINDOW})"""


def _conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions that read what they write, a window before they commit."""
    rows = entry_log(spark, folder, "user_key", "version", "meta", once=False).where(codec.has("meta", codec.TXN))
    reads = rows.select(F.col("version").alias("txn"), "user_key", (F.col("version") - WINDOW).alias("read_ts"), F.col("version").alias("commit_ts"))
    return txn.conflicts(rows.select("user_key", F.col("version").alias("commit_ts")), reads)


@query(f"{_CONFLICT} select txn, count(*) as n, min(other) as first_ts from c group by txn")
def conflict_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The commits that each transaction conflicts with, counted."""
    return _conflicts(spark, folder)


@query(f"{_CONFLICT} select (select count(distinct version) from w) as txns, (select count(distinct txn) from c) as aborted")
def conflict_aborts(spark: SparkSession, folder: str) -> DataFrame:
    """How many transactions there are and abort."""
    log = entry_log(spark, folder, "version", "meta", once=False).where(codec.has("meta", codec.TXN))
    each = log.select("version", F.lit(False).alias("aborted")).unionByName(_conflicts(spark, folder).select(F.col("txn").alias("version"), F.lit(True).alias("aborted")))
    per_txn = each.groupBy("version").agg(F.bool_or("aborted").alias("aborted"))
    return per_txn.agg(F.count("*").alias("txns"), F.count_if("aborted").alias("aborted"))


@query(
    f"""{_CONFLICT}, k as (select version as txn, user_key, max(seq) as seq from log where (meta & 64) <> 0 and version not in (select txn from c) group by 1, 2),
r as (select txn, row_number() over (order by txn) - 1 + {READ_TS} * 2 as commit_ts from (select distinct txn from k))
select txn, decode(user_key) as user_key, seq, commit_ts::bigint as commit_ts from k join r using (txn)"""
)
def txn_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Writes of the transactions that don't abort, under their commit versions."""
    rows = entry_log(spark, folder, "user_key", "version", "seq", "meta", once=False).where(codec.has("meta", codec.TXN)).withColumnRenamed("version", "txn")
    done = txn.committed(rows, _conflicts(spark, folder), READ_TS * 2)
    return done.select("txn", _text("user_key"), "seq", F.col("commit_ts").cast("long").alias("commit_ts"))


# --- log replay -------------------------------------------------------------------

_SIZE = f"2 + {_VARINT.format('octet_length(user_key) + 8')} + {_VARINT.format('octet_length(value)')} + {_VARINT.format('expires_at')} + octet_length(user_key) + 8 + octet_length(value) + 4"
_FRAMES = f"""{LOG}, l0 as (select fid, version as ts, seq, user_key, value, expires_at, case when (meta & 64) <> 0 then 'T' else 'P' end as k from log where fid is not null
  union all select fid, version, max(seq), 'txn'::blob, encode(version::varchar), 0, 'F' from log where (meta & 64) <> 0 and fid is not null and not (fid % 7 = 3 and version % 11 = 5) group by fid, version),
l as (select fid, ts, decode(user_key) as key, k, size, (20 + coalesce(sum(size) over (partition by fid order by ts, strpos('TFP', k), seq rows between unbounded preceding and 1 preceding), 0))::bigint as off
  from (select *, {_SIZE} as size from l0)),
a as (select *, coalesce(sum((k = 'F')::int) over (partition by fid order by off rows between unbounded preceding and 1 preceding), 0) as grp from l),
b as (select *, first_value(case when k = 'T' then ts end ignore nulls) over (partition by fid, grp order by off rows unbounded preceding) as open_ts from a),
c as (select *, case k when 'T' then ts <> open_ts when 'F' then ts <> coalesce(open_ts, 0) else open_ts is not null end as bad from b),
d as (select *, coalesce(min(case when bad then off end) over (partition by fid), 9223372036854775807) as fb from c),
e as (select *, max(case when k = 'F' and off < fb then 1 else 0 end) over (partition by fid, grp) as fin from d)"""
_REPLAYED = f"{_FRAMES} select fid, off as \"offset\", key, ts from e where off < fb and (k = 'P' or (k = 'T' and fin = 1))"


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """The log's writes in files with frames; in every seventh file some transactions were never finished."""
    log = entry_log(spark, folder, "user_key", "version", "value", "meta", "user_meta", "expires_at", "fid", "seq")
    return log_frames(log, (F.col("fid") % 7 == 3) & (F.col("version") % 11 == 5))


@query(_REPLAYED)
def wal_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a replay of the log files gives."""
    return wal.replay(_frames(spark, folder).select("fid", "offset", "size", "key", "kind", "ts")).select("fid", "offset", "key", "ts")


@query(f"{_FRAMES} select fid, coalesce(max(off + size) filter (off < fb and k in ('P', 'F')), 20)::bigint as valid_end from e group by fid")
def wal_valid_end(spark: SparkSession, folder: str) -> DataFrame:
    """Where each log file is valid up to."""
    return wal.valid_end(_frames(spark, folder))


@query(f"{_FRAMES}, v as (select fid, coalesce(max(off + size) filter (off < fb and k in ('P', 'F')), 20) as ve from e group by fid) select fid, count(*) as n from l join v using (fid) where off < ve group by fid")
def wal_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each log file keeps when it is cut at its valid end."""
    return wal.truncated(_frames(spark, folder)).groupBy("fid").agg(F.count("*").alias("n"))


@query(f"{_FRAMES} select key, ts, max(fid * 1000000000 + off)::bigint as place from e where off < fb and (k = 'P' or (k = 'T' and fin = 1)) group by key, ts")
def memtable_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each key and timestamp after a replay."""
    return wal.memtable(_frames(spark, folder)).select("key", "ts", (F.col("fid") * 1_000_000_000 + F.col("offset")).alias("place"))


# --- tables -----------------------------------------------------------------------

_MANIFEST = """with c as (select * from (select seq, table_id, level, key_id, upper(trim(op)) in ('CREATE', '0') as created,
  row_number() over (partition by seq order by table_id, level nulls first, key_id nulls first) as copy from manifest_log
  where upper(trim(op)) in ('CREATE', 'DELETE', '0', '1') and seq is not null and table_id is not null) where copy = 1),
m as (select * from (select *, row_number() over (partition by table_id order by seq desc) as rn from c) where rn = 1 and created),
i as (select distinct table_id, level from table_info)"""


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_log")


@query(f"{_MANIFEST} select table_id, level, key_id, seq from m")
def manifest_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of the manifest."""
    return manifest.state(_manifest(spark, folder))


@query(
    f"{_MANIFEST}, w as (select *, coalesce(lag(created) over (partition by table_id order by seq), false) as was from c) "
    "select seq, table_id, case when created then 'exists' else 'missing' end as error from w where created = was"
)
def manifest_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that a strict fold refuses."""
    return manifest.errors(_manifest(spark, folder))


@query(f"{_MANIFEST} select count(*) filter (created) as creations, count(*) filter (not created) as deletions, (select count(*) from m) as tables from c")
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Creations, deletions and tables."""
    return manifest.counts(_manifest(spark, folder))


@query(f"{_MANIFEST} select table_id, level from m where table_id not in (select table_id from i)")
def reconcile_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of the manifest that aren't there."""
    return manifest.missing_on_disk(_manifest(spark, folder), table(spark, folder, "table_info"))


@query(f"{_MANIFEST} select table_id, level from i where table_id not in (select table_id from m)")
def reconcile_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that the manifest doesn't know."""
    return manifest.orphans(_manifest(spark, folder), table(spark, folder, "table_info"))


_TABLES = """with t as (select * from (select *, row_number() over (partition by table_id order by key_count desc, level desc, smallest desc) as copy from table_info where table_id is not null) where copy = 1)"""


@query(f"{_TABLES} select table_id, level, decode(smallest) as smallest, decode(biggest) as biggest, key_count, on_disk_size, max_version from t")
def table_info(spark: SparkSession, folder: str) -> DataFrame:
    """The tables, by level and key."""
    rows = manifest.in_order(table(spark, folder, "table_info"))
    return rows.select("table_id", "level", _text("smallest"), _text("biggest"), "key_count", "on_disk_size", "max_version")


@query(f"{_TABLES} select table_id, level, row_number() over (partition by level order by case when level = 0 then table_id end, smallest, table_id) as place from t")
def tables_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Each table's place in its level."""
    rows = manifest.tables(table(spark, folder, "table_info")).select("table_id", "level", "smallest").withColumn("in_zero", F.when(F.col("level") == 0, F.col("table_id")))
    placed = ranges.numbered(rows, ["level", "in_zero", "smallest", "table_id"], "_place", 1)
    first = placed.groupBy("level").agg(F.min("_place").alias("_first"))
    return placed.join(first, "level").select("table_id", "level", (F.col("_place") - F.col("_first") + 1).alias("place"))


@query(f"{_TABLES} select level, count(*) as n_tables, sum(key_count)::bigint as key_count, sum(on_disk_size)::bigint as on_disk_size, max(max_version) as max_version, max(table_id) + 1 as next_id from t group by level")
def level_info(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sizes of each level."""
    return manifest.levels(table(spark, folder, "table_info"))


@query(
    f"{_TABLES}, o as (select *, lag(biggest) over (partition by level order by smallest, smallest_ver desc, table_id) as prior from t where level > 0) "
    "select level, table_id, case when prior >= smallest then 'overlap' else 'inverted' end as error from o where prior >= smallest or smallest > biggest"
)
def level_overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that overlap the one before."""
    return manifest.overlaps(table(spark, folder, "table_info"))


@query(f"{LOG} select greatest((select coalesce(max(version), 0) from log), (select coalesce(max(max_version), 0) from table_info))::bigint as max_version")
def max_version(spark: SparkSession, folder: str) -> DataFrame:
    """The highest version in memory and in tables."""
    both = entry_log(spark, folder, "version", once=False).unionByName(table(spark, folder, "table_info").select(F.col("max_version").alias("version")))
    return both.agg(F.coalesce(F.max("version"), F.lit(0)).alias("max_version"))


@query(
    f"""{LOG}, g as (select table_id, count(*) as key_count, max(version) as max_version, min(user_key) as s, max(user_key) as b, sum(octet_length(value))::bigint as value_bytes from log where table_id is not null group by table_id)
select g.table_id, key_count, max_version, value_bytes, decode(s) as smallest, max(l.version) filter (l.user_key = s) as smallest_ver, decode(b) as biggest, min(l.version) filter (l.user_key = b) as biggest_ver
from g join log l on l.table_id = g.table_id and (l.user_key = s or l.user_key = b) group by all"""
)
def table_meta(spark: SparkSession, folder: str) -> DataFrame:
    """What the entries flushed to each table add up to."""
    log = entry_log(spark, folder, "user_key", "version", "value_bytes", "table_id")
    rows = manifest.table_meta(log, F.col("value_bytes"))
    return rows.withColumns({"smallest": F.col("smallest").cast("string"), "biggest": F.col("biggest").cast("string"), "value_bytes": F.col("value_bytes").cast("long")})


@query(f"{_MANIFEST} select table_id as fid from i where table_id not in (select table_id from c where not created) group by 1")
def remaining_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files without those that a change deletes."""
    gone = manifest.changes(_manifest(spark, folder)).where("not created").select(F.col("table_id").alias("fid")).distinct()
    return manifest.remaining_files(table(spark, folder, "table_info").where("table_id is not null").select(F.col("table_id").alias("fid")), gone)


def _sorted_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The flushed entries as internal keys with the bytes of their stored values."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value_bytes", "expires_at", "table_id").where("table_id is not null")
    size = codec.stored_bytes(F.col("value_bytes"), F.col("expires_at")).cast("long")
    return log.select("table_id", "seq", codec.key_with_version(F.col("user_key"), F.col("version")).alias("key"), "user_key", (-F.col("version")).alias("newest_first"), size.alias("size"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    order = ["user_key", "newest_first", "seq"]
    return greedy.streamed(_sorted_entries(spark, folder), "table_id", order, ["key", "size"], greedy.blocks(), "block long, base_key binary, overlap int, lcp int, begins long")


_SAME = "list_filter(range(1, least(length(s.k), length(f.base)) // 2 + 1), lambda i: substr(s.k, 2 * i - 1, 2) <> substr(f.base, 2 * i - 1, 2))[1]"
_CUT = "f.fin + 6 + length(s.k) // 2 + s.size + (f.n + 1) * 4 + 16 > 4096"
_BLOCKS = f"""{LOG.replace('with log', 'with recursive log')}, s as (select table_id, seq, hex(user_key) || printf('%016X', (18446744073709551615::ubigint - version::ubigint)) as k,
  octet_length(value) + 2 + {_VARINT.format('expires_at')} as size, row_number() over (partition by table_id order by user_key, version desc, seq) as i from log where table_id is not null),
f(table_id, i, seq, block, base, overlap, lcp, begins, fin, n) as (select table_id, i, seq, 0, k, 0, 0, 0, 4 + length(k) // 2 + size, 1 from s where i = 1
  union all select s.table_id, s.i, s.seq, case when {_CUT} then f.block + 1 else f.block end, case when {_CUT} then s.k else f.base end,
  case when {_CUT} then 0 else coalesce({_SAME} - 1, 0) end, case when {_CUT} then 0 else coalesce({_SAME} - 1, least(length(s.k), length(f.base)) // 2) end,
  case when {_CUT} then 0 else f.fin end, case when {_CUT} then 4 + length(s.k) // 2 + s.size else f.fin + 4 + length(s.k) // 2 - coalesce({_SAME} - 1, 0) + s.size end,
  case when {_CUT} then 1 else f.n + 1 end from f join s on s.table_id = f.table_id and s.i = f.i + 1)"""


@query(f"{_BLOCKS} select table_id, seq, block::bigint as block, base as base_key, overlap::int as overlap, lcp::int as lcp, begins::bigint as begins from f")
def block_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The block of each entry of each table."""
    rows = _blocks(spark, folder)
    return rows.select("table_id", "seq", "block", F.hex("base_key").alias("base_key"), "overlap", "lcp", "begins")


@query(
    f"""{_BLOCKS} select table_id, block::bigint as block, min(base) as base_key, count(*) as entries, max(fin)::bigint as data_bytes,
(max(fin) + count(*) * 4 + 16)::bigint as bytes from f group by table_id, block"""
)
def block_index(spark: SparkSession, folder: str) -> DataFrame:
    """First key, entries and bytes of each block: the index of each table."""
    rows = _blocks(spark, folder)
    end = F.col("begins") + 4 + F.octet_length("key") - F.col("overlap") + F.col("size")
    out = rows.groupBy("table_id", "block").agg(F.hex(F.min("base_key")).alias("base_key"), F.count("*").alias("entries"), F.max(end).cast("long").alias("data_bytes"))
    # offsets, their number, a checksum message of at most 8 bytes and its length
    return out.withColumn("bytes", F.col("data_bytes") + F.col("entries") * 4 + 4 + 8 + 4)


@query()
def block_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each block of each table without its checksum (headers, keys, stored values, offsets), and their checksum."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value", "meta", "user_meta", "expires_at", "table_id").where("table_id is not null")
    stored = codec.stored_value(F.col("meta"), F.col("user_meta"), F.col("expires_at"), F.col("value"))
    key = codec.key_with_version(F.col("user_key"), F.col("version"))
    rows = log.select("table_id", "seq", "user_key", (-F.col("version")).alias("newest_first"), key.alias("key"), stored.alias("stored"))
    blocks = greedy.laid_out(rows, "table_id", ["user_key", "newest_first", "seq"], "key", "stored")
    return checksums.summed(blocks).select("table_id", "block", F.octet_length("data").alias("bytes"), "crc")


_FIRST = f"""{LOG}, b as (select table_id, min(user_key) as base from log where table_id is not null group by table_id),
x as (select l.seq, user_key as k, base, list_filter(range(1, least(octet_length(user_key), octet_length(base)) + 1), lambda i: substr(hex(user_key), 2 * i - 1, 2) <> substr(hex(base), 2 * i - 1, 2)) as d,
  least(octet_length(user_key), octet_length(base)) as n from log l join b using (table_id))"""


@query(f"{_FIRST} select seq, coalesce(d[1] - 1, n)::int as lcp, coalesce(d[1] - 1, 0)::int as overlap from x")
def prefix_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """What each key shares with its table's first key."""
    log = entry_log(spark, folder, "user_key", "seq", "table_id").where("table_id is not null")
    first = log.groupBy("table_id").agg(F.min("user_key").alias("base"))
    rows = log.join(first, "table_id")
    return rows.select("seq", codec.common_prefix(F.col("user_key"), F.col("base")).cast("int").alias("lcp"), codec.overlap(F.col("user_key"), F.col("base")).cast("int").alias("overlap"))


@query(f"{LOG} select decode(user_key) as user_key, version, seq from ({_newest('true', 2)}) where not (expires_at <> 0 and expires_at <= {NOW})")
def compaction_retain_n(spark: SparkSession, folder: str) -> DataFrame:
    """The two newest unexpired writes of each key."""
    return mvcc.retained(entry_log(spark, folder, "user_key", "version", "seq", "expires_at"), 2, NOW).select(_text("user_key"), "version", "seq")


@query(f"{LOG} select decode(user_key) as user_key, version, seq from ({_newest()}) where {_LIVE}")
def drop_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """What a compaction to the lowest level keeps."""
    return mvcc.compacted_to_bottom(entry_log(spark, folder, "user_key", "version", "seq", "meta", "expires_at", once=False), NOW).select(_text("user_key"), "version", "seq")


@query(f"{LOG}, d as (select user_key, max(version) as cut from log where (meta & 4) <> 0 group by user_key) select decode(l.user_key) as user_key, version, seq from log l left join d using (user_key) where cut is null or version >= cut")
def discard_earlier(spark: SparkSession, folder: str) -> DataFrame:
    """The log without discarded earlier versions."""
    return mvcc.without_discarded(entry_log(spark, folder, "user_key", "version", "seq", "meta")).select(_text("user_key"), "version", "seq")


@query(f"{LOG} select decode(user_key) as user_key, count(*) as writes, sum(octet_length(value))::bigint as bytes, max(user_meta) as user_meta from log where {_LIVE} group by user_key")
def merge_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Each key's writes folded by a sum, a count and a maximum."""
    log = entry_log(spark, folder, "user_key", "value_bytes", "meta", "user_meta", "expires_at")
    fold = {"writes": F.count("*"), "bytes": F.sum("value_bytes").cast("long"), "user_meta": F.max("user_meta")}
    return mvcc.merged(log, fold, NOW).withColumn("user_key", F.col("user_key").cast("string"))


@query(
    f"""{LOG} select decode(user_key) as user_key, list_reduce(list_concat([0::bigint], list(version % 997 + octet_length(value) order by version, seq)), lambda h, v: (h * 31 + v) % 1000003) as merged
from log where {_LIVE} group by user_key"""
)
def merge_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Each key's writes folded in their order, by a sum whose digits are the writes."""
    log = entry_log(spark, folder, "user_key", "version", "seq", "value_bytes", "meta", "expires_at")
    element = F.struct((F.col("version") % 997 + F.col("value_bytes")).alias("sum"), F.lit(31).cast("long").alias("times"))

    def combine(a, b):
        return F.struct(((a["sum"] * b["times"] + b["sum"]) % 1_000_003).alias("sum"), (a["times"] * b["times"] % 1_000_003).alias("times"))

    done = mvcc.merged_in_order(log, element, combine, NOW)
    return done.select(_text("user_key"), F.col("merged.sum").alias("merged"))


# --- filters -----------------------------------------------------------------------


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return entry_log(spark, folder, "user_key", "table_id").where("table_id is not null")


@query(
    f"""{LOG}, n as (select table_id, count(*) as n from log where table_id is not null group by table_id)
select table_id, n, ((greatest(n * 7, 64) + 7) // 8 * 8)::bigint as bits, 4 as probes from n"""
)
def bloom_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Bits and probes of each table's filter for one false positive in a hundred."""
    return bloom.filter_sizes(_members(spark, folder), 0.01)


_HASHED = f"""{LOG}, hx as (select distinct table_id, user_key, hex(user_key) as x, octet_length(user_key) as n from log where table_id is not null),
h0 as (select *, list_reduce(list_concat([xor(3164544308::ubigint, (n * 3332679571::ubigint) % 4294967296)], list_transform(range(0, n // 4), lambda i: ('0x' || substr(x, 8 * i + 7, 2) || substr(x, 8 * i + 5, 2) || substr(x, 8 * i + 3, 2) || substr(x, 8 * i + 1, 2))::ubigint)),
  lambda h, w: xor(((h + w) % 4294967296 * 3332679571::ubigint) % 4294967296, (((h + w) % 4294967296 * 3332679571::ubigint) % 4294967296) >> 16)) as h,
  case n % 4 when 0 then null when 1 then ('0x' || substr(x, 2 * n - 1, 2))::ubigint when 2 then ('0x' || substr(x, 2 * n - 1, 2) || substr(x, 2 * n - 3, 2))::ubigint
  else ('0x' || substr(x, 2 * n - 1, 2) || substr(x, 2 * n - 3, 2) || substr(x, 2 * n - 5, 2))::ubigint end as t from hx),
hs as (select table_id, user_key, case when t is null then h else xor(((h + t) % 4294967296 * 3332679571::ubigint) % 4294967296, (((h + t) % 4294967296 * 3332679571::ubigint) % 4294967296) >> 24) end as h from h0),
z as (select table_id, (greatest(count(*) * 7, 64) + 7) // 8 * 8 as bits from log where table_id is not null group by table_id),
b as (select distinct table_id, ((h + ((h >> 17) | (h << 15) % 4294967296) * r.range) % 4294967296) % bits as bit from hs join z using (table_id), range(4) r),
a as (select distinct table_id + o.range as table_id, user_key, h from hs, range(2) o),
q as (select a.table_id, a.user_key, coalesce(bool_and(z.bits is null or b.bit is not null), true) as maybe from a left join z using (table_id) cross join range(4) r
  left join b on b.table_id = a.table_id and b.bit = ((h + ((h >> 17) | (h << 15) % 4294967296) * r.range) % 4294967296) % z.bits group by 1, 2)"""


@query(f"{_HASHED} select table_id, (bit // 32)::bigint as word, sum(1::bigint << (bit % 32)::int)::bigint as mask from b group by 1, 2")
def bloom_build(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each table's filter."""
    keys = _members(spark, folder)
    return bloom.build(keys, bloom.filter_sizes(keys, 0.01))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Each flushed key, asked of its table and of the next one."""
    keys = _members(spark, folder)
    return keys.unionByName(keys.withColumn("table_id", F.col("table_id") + 1)).distinct()


@query(f"{_HASHED} select table_id, decode(user_key) as user_key, maybe from q")
def bloom_probe(spark: SparkSession, folder: str) -> DataFrame:
    """What the filters say of keys that are in them and of others."""
    keys = _members(spark, folder)
    shapes = bloom.filter_sizes(keys, 0.01)
    return bloom.probe(_asked(spark, folder), bloom.build(keys, shapes), shapes).withColumn("user_key", F.col("user_key").cast("string"))


@query(
    f"""{_HASHED}, w as (select q.*, hs.h is not null as known from q left join hs using (table_id, user_key) where table_id in (select table_id from z))
select count(*) filter (not known) as absent, count(*) filter (not known and maybe) as wrong, count(*) filter (known and not maybe) as denied,
round(count(*) filter (not known and maybe) / count(*) filter (not known), 6) as rate from w"""
)
def bloom_fp_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How often the filters are wrong."""
    keys = _members(spark, folder)
    shapes = bloom.filter_sizes(keys, 0.01)
    asked = _asked(spark, folder).join(shapes.select("table_id"), "table_id", "left_semi")
    return bloom.false_positive_rate(bloom.probe(asked, bloom.build(keys, shapes), shapes), keys)


# --- codecs ---------------------------------------------------------------------------



@query(
    f"""{LOG} select seq, (2 + {_VARINT.format('octet_length(user_key)')} + {_VARINT.format('octet_length(value)')} + {_VARINT.format('expires_at')})::int as header_bytes,
(2 + {_VARINT.format('octet_length(user_key)')} + {_VARINT.format('octet_length(value)')} + {_VARINT.format('expires_at')} + octet_length(user_key) + octet_length(value) + 4)::int as entry_bytes,
(octet_length(value) + 2 + {_VARINT.format('expires_at')})::int as value_bytes from log"""
)
def encoded_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded lengths of each entry."""
    k, v, e = F.col("user_key"), F.col("value"), F.col("expires_at")
    log = entry_log(spark, folder, "user_key", "value", "expires_at", "seq")
    return log.select("seq", codec.header_bytes(k, v, e).cast("int").alias("header_bytes"), codec.entry_bytes(k, v, e).cast("int").alias("entry_bytes"), codec.value_bytes(v, e).cast("int").alias("value_bytes"))


@query(f"{LOG} select seq, hex(user_key) || printf('%016X', (18446744073709551615::ubigint - version::ubigint)) as internal_key from log")
def internal_key_hex(spark: SparkSession, folder: str) -> DataFrame:
    """Internal keys."""
    log = entry_log(spark, folder, "user_key", "version", "seq")
    return log.select("seq", F.hex(codec.key_with_version(F.col("user_key"), F.col("version"))).alias("internal_key"))


@query(f"{LOG} select seq, decode(user_key) as user_key, version from log")
def parse_internal_key(spark: SparkSession, folder: str) -> DataFrame:
    """Internal keys taken apart again."""
    log = entry_log(spark, folder, "user_key", "version", "seq").select("seq", codec.key_with_version(F.col("user_key"), F.col("version")).alias("k"))
    return log.select("seq", codec.user_key(F.col("k")).cast("string").alias("user_key"), codec.version_of(F.col("k")).alias("version"))


@query(f"{LOG} select seq, meta, user_meta, expires_at, hex(value) as value from log")
def stored_value_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Stored values encoded and decoded again."""
    log = entry_log(spark, folder, "seq", "meta", "user_meta", "expires_at", "value")
    data = log.select("seq", codec.stored_value(F.col("meta"), F.col("user_meta"), F.col("expires_at"), F.col("value")).alias("d"))
    return data.select("seq", codec.unstored_value(F.col("d")).alias("v")).select("seq", "v.meta", "v.user_meta", "v.expires_at", F.hex("v.value").alias("value"))


@query()
def checksum_verify(spark: SparkSession, folder: str) -> DataFrame:
    """The checksum of each entry as it is encoded, with its internal key, and whether the entry read back gives it."""
    log = entry_log(spark, folder, "seq", "version", "meta", "user_meta", "user_key", "value", "expires_at")
    return files.verified(files.encoded(log).select("seq", "entry")).select("seq", "crc", "ok")


# --- value log -------------------------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as entries: a writer for each hundred ids, so that writers grow with the table; in order of id."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("doc_id is not null")
    return docs.select(
        F.floor(F.col("doc_id") / 100).alias("writer"),
        F.col("doc_id").alias("seq"),
        F.encode(F.lpad(F.col("doc_id").cast("string"), 10, "0"), "UTF-8").alias("user_key"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("value"),
        F.lit(0).alias("meta"),
        F.lit(0).cast("long").alias("expires_at"),
    )


_DOCS = "with d as (select doc_id // 100 as writer, doc_id as seq, coalesce(strlen(text), 0) as n from documents where doc_id is not null)"
_LEN = f"(2 + 1 + {_VARINT.format('n')} + 1 + 10 + n + 4)"


@query(f"{_DOCS} select n < {TEXT_THRESHOLD} as inline, count(*) as entries, sum(n)::bigint as bytes from d group by 1")
def vlog_split(spark: SparkSession, folder: str) -> DataFrame:
    """How many values stay with their keys."""
    rows = vlog.split(_documents(spark, folder), TEXT_THRESHOLD)
    return rows.groupBy("inline").agg(F.count("*").alias("entries"), F.sum(F.octet_length("value")).cast("long").alias("bytes"))


@query(
    f"""with recursive d as (select doc_id // 100 as writer, doc_id as seq, coalesce(strlen(text), 0) as n from documents where doc_id is not null),
s as (select writer, seq, {_LEN} as len, row_number() over (partition by writer order by seq) as i from d where n >= {TEXT_THRESHOLD}),
f(writer, i, seq, len, fid, off, cnt) as (select writer, i, seq, len, 1, 20, 0 from s where i = 1
  union all select s.writer, s.i, s.seq, s.len, case when f.off + f.len > {FILE_BYTES} or f.cnt + 1 > {FILE_ENTRIES} then f.fid + 1 else f.fid end,
  case when f.off + f.len > {FILE_BYTES} or f.cnt + 1 > {FILE_ENTRIES} then 20 else f.off + f.len end,
  case when f.off + f.len > {FILE_BYTES} or f.cnt + 1 > {FILE_ENTRIES} then 0 else f.cnt + 1 end from f join s on s.writer = f.writer and s.i = f.i + 1)
select writer, seq, fid::bigint as fid, off::bigint as "offset", len::bigint as len from f"""
)
def vlog_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """File and offset of each large value."""
    return vlog.places(_documents(spark, folder), TEXT_THRESHOLD, FILE_BYTES, FILE_ENTRIES).select("writer", "seq", "fid", "offset", "len")


@query("select doc_id as seq, md5(coalesce(text, '')) as value from documents where doc_id is not null")
def vlog_deref(spark: SparkSession, folder: str) -> DataFrame:
    """Values read back through their pointers."""
    docs = _documents(spark, folder)
    entries = vlog.with_pointers(docs, vlog.places(docs, TEXT_THRESHOLD, FILE_BYTES, FILE_ENTRIES))
    written = vlog.write(docs, TEXT_THRESHOLD, FILE_BYTES, FILE_ENTRIES)
    return vlog.dereferenced(entries, written).select("seq", F.md5("value").alias("value"))


@query(
    f"""with recursive r as (select doc_id // 100 as writer, doc_id // 10 as request, sum(10 + coalesce(strlen(text), 0) + 22 + 4)::bigint as size from documents where doc_id is not null group by 1, 2),
s as (select *, row_number() over (partition by writer order by request) as i from r),
f(writer, request, size, i, "offset") as (select writer, request, size, i, 0::bigint from s where i = 1
  union all select s.writer, s.request, s.size, s.i, case when f."offset" + f.size >= {FILE_BYTES} then 0 else f."offset" + f.size end from f join s on s.writer = f.writer and s.i = f.i + 1)
select writer, request, size, "offset", "offset" + size > 4294967295 as too_big from f"""
)
def vlog_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The offsets that a check of write requests reckons with; a request has a writer's documents of ten ids."""
    rows = vlog.request_sizes(_documents(spark, folder).withColumn("request", F.floor(F.col("seq") / 10)), "request")
    return greedy.streamed(rows, "writer", ["request"], ["size"], greedy.requests(FILE_BYTES), "offset long, too_big boolean")


@query(
    f"""{LOG.replace('with log', 'with recursive log')}, s as (select fid, seq, octet_length(user_key) + octet_length(value) as n, row_number() over (partition by fid order by seq) as i from log),
f(fid, i, seq, n, segment, used) as (select fid, i, seq, n, 0, 0 from s where i = 1
  union all select s.fid, s.i, s.seq, s.n, case when f.used + f.n >= {SEGMENT} then f.segment + 1 else f.segment end, case when f.used + f.n >= {SEGMENT} then 0 else f.used + f.n end
  from f join s on s.fid = f.fid and s.i = f.i + 1)
select fid, seq, segment::bigint as segment, used::bigint as "offset" from f"""
)
def memtable_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """The memtable that each write of a log file goes to."""
    log = entry_log(spark, folder, "fid", "seq", "user_key", "value_bytes").withColumn("n", (F.octet_length("user_key") + F.col("value_bytes")).cast("long"))
    return greedy.streamed(log.select("fid", "seq", "n"), "fid", ["seq"], ["n"], greedy.rotate(SEGMENT), "segment long, offset long").select("fid", "seq", "segment", "offset")


_DISCARD = f"""{LOG}, d as (select seq, fid, case when (meta & 4) <> 0 then -1 when (meta & 2) <> 0 then octet_length(value) else 0 end as delta from log where (meta & 7) <> 0),
r as (select fid, max(seq) filter (delta < 0) as reset, max(delta) as most from d group by fid),
s as (select r.fid, coalesce(sum(d.delta), 0)::bigint as discarded from r left join d on d.fid = r.fid and d.delta > 0 and (reset is null or d.seq > reset) where most > 0 group by r.fid)"""


def _discards(spark: SparkSession, folder: str) -> DataFrame:
    return vlog.discard_stats(discard_log(entry_log(spark, folder, "seq", "fid", "meta", "value")))


@query(f"{_DISCARD} select fid, discarded from s")
def discard_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes to discard in each file."""
    return _discards(spark, folder)


@query(f"{_DISCARD} select fid, discarded from s order by discarded desc, fid limit 1")
def max_discard(spark: SparkSession, folder: str) -> DataFrame:
    """The file with most to discard."""
    return vlog.max_discard(_discards(spark, folder))


@query(f"{LOG}, n as (select user_key, seq as newest from ({_newest()})) select fid, sum(octet_length(value))::bigint as bytes from log join n using (user_key) where (meta & 2) <> 0 and seq <> newest group by fid")
def superseded_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of pointed values that newer writes have made garbage."""
    return vlog.superseded(entry_log(spark, folder, "user_key", "version", "seq", "fid", "meta", "value"))


# --- watermark, expiry --------------------------------------------------------------------

_MARKS = """with m as (select distinct stream_id as name, run_id as idx, case when lower(trim(status)) = 'running' then 1 else -1 end as d from feed_runs
  where run_id is not null and stream_id is not null and status is not null),
e as (select name, idx, sum(d)::bigint as pend from m group by name, idx)"""


@query(f"{_MARKS}, f as (select name, min(idx) filter (pend > 0) as first_open from e group by name) select f.name, coalesce(max(e.idx) filter (pend <= 0 and (first_open is null or idx < first_open)), 0)::bigint as done_until from f join e using (name) group by f.name")
def low_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """Per stream, the run up to which all are over."""
    return watermark.low_watermark(mark_log(table(spark, folder, "feed_runs")))


@query(f"{_MARKS} select name, idx, pend as open from e where pend > 0")
def pending_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that aren't over."""
    return watermark.pending(mark_log(table(spark, folder, "feed_runs")))


@query(f"{LOG} select strftime(make_timestamp(expires_at * 1000000), '%Y-%m-%d') as day, count(*) as n from log where expires_at <> 0 group by 1")
def ttl_expiry_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Writes by the day they expire."""
    return mvcc.expiry_days(entry_log(spark, folder, "expires_at")).withColumn("day", F.col("day").cast("string"))
