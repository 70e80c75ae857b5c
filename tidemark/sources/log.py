"""Entry logs as DataFrames: writes in the order they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import DELETE, FIN_TXN, TXN, entry_bytes, key_with_version
from tidemark.sources.files import FILE_HEAD
from tidemark.sources.tables import BLANKS, has_key, table

COLUMNS = ("user_key", "version", "value", "meta", "user_meta", "expires_at", "fid", "log_offset", "seq", "table_id")


def entries(raw: DataFrame, *columns: str, once: bool = True) -> DataFrame:
    """The writes of an entry log, each once.

    Rows without key, version or seq are none. Of the rows of one seq, which are the same
    write, the one at the lowest (fid, log_offset) stays. Null value, meta, user_meta and
    expiry are empty and 0. With `columns`, only those are read beside the places;
    `value_bytes` is the value's length, taken before anything is exchanged.
    `once=False` leaves copies in, and spares an exchange, for results that one more copy
    of a write doesn't change. Filters on key or version belong on `raw`: they reach the scan.
    """
    wanted = columns or COLUMNS
    rows = raw.where(has_key("user_key") & F.col("version").isNotNull() & F.col("seq").isNotNull())
    if "value_bytes" in wanted:
        rows = rows.withColumn("value_bytes", F.octet_length(F.coalesce("value", F.lit(b""))))
    if once:
        first = Window.partitionBy("seq").orderBy("fid", "log_offset")
        need = list(dict.fromkeys([*wanted, "seq", "fid", "log_offset"]))
        rows = rows.select(*need).withColumn("_copy", F.row_number().over(first)).where("_copy = 1")
    empty = {"value": F.lit(b""), "meta": F.lit(0), "user_meta": F.lit(0), "expires_at": F.lit(0).cast("long")}
    return rows.select(*[F.coalesce(c, empty[c]).alias(c) if c in empty else c for c in wanted])


def entry_log(spark: SparkSession, folder: str, *columns: str, once: bool = True, where: Column | None = None) -> DataFrame:
    """`entries` of a folder's entry_log, of those rows that a condition on key or version holds for."""
    raw = table(spark, folder, "entry_log")
    return entries(raw if where is None else raw.where(where), *columns, once=once)


#: Fixed value: the key of the row that finishes a transaction, behind the reserved prefix.
FINISH = b"txn"


def log_frames(log: DataFrame, unfinished: Column | None = None) -> DataFrame:
    """(fid, offset, size, key, kind, ts, ...): the writes of a log as log files with transaction frames hold them.

    `log` has fid, version, seq, user_key, value, meta, user_meta and expires_at. In a file,
    writes stand in order of version: those of a transaction (kind T), the row that finishes
    it (F), its version as text, then others (P), each as long as it is encoded. Finishing
    rows for which `unfinished` holds are left out, as if the writer had been stopped. A file
    is bounded by its size limit, and so is its window.
    """
    rows = log.where("fid is not null").withColumn("kind", F.when(F.col("meta").bitwiseAND(TXN) != 0, "T").otherwise("P"))
    ends = rows.where("kind = 'T'").groupBy("fid", "version").agg(F.max("seq").alias("seq"))
    ends = ends if unfinished is None else ends.where(~unfinished)
    finish = ends.select(
        "fid", "version", "seq", F.lit(FINISH).alias("user_key"), F.encode(F.col("version").cast("string"), "UTF-8").alias("value"),
        F.lit(FIN_TXN).alias("meta"), F.lit(0).alias("user_meta"), F.lit(0).cast("long").alias("expires_at"), F.lit("F").alias("kind"),
    )
    size = entry_bytes(key_with_version(F.col("user_key"), F.col("version")), F.col("value"), F.col("expires_at")).cast("long")
    order = Window.partitionBy("fid").orderBy("version", F.when(F.col("kind") == "T", 0).when(F.col("kind") == "F", 1).otherwise(2), "seq")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.select(*finish.columns).unionByName(finish).withColumn("size", size).withColumn("offset", F.lit(FILE_HEAD) + before)
    return out.withColumns({"key": F.col("user_key").cast("string"), "ts": F.col("version")})


def discard_log(log: DataFrame) -> DataFrame:
    """(seq, fid, delta): bytes of value pointers that were superseded, and resets (-1) where a write discards earlier versions."""
    reset = F.col("meta").bitwiseAND(4) != 0
    gone = F.when(reset, F.lit(-1)).when(F.col("meta").bitwiseAND(2) != 0, F.octet_length("value")).when(F.col("meta").bitwiseAND(DELETE) != 0, F.lit(0))
    return log.select("seq", "fid", gone.cast("long").alias("delta")).where("delta is not null")


def mark_log(reports: DataFrame) -> DataFrame:
    """(name, idx, kind): runs as marks, begun once reported running, done once reported otherwise; one of each kind a run."""
    running = F.lower(F.btrim(F.col("status"), F.lit(BLANKS))) == "running"
    marks = reports.where("run_id is not null and stream_id is not null and status is not null")
    return marks.select(F.col("stream_id").alias("name"), F.col("run_id").alias("idx"), F.when(running, "begin").otherwise("done").alias("kind")).distinct()
