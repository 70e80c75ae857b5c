"""The set of tables: its changes, its levels, and what lies on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.sources.tables import BLANKS


def changes(log: DataFrame) -> DataFrame:
    """(seq, table_id, level, key_id, created): each change once; op by name in any case or by number, others are none."""
    op = F.upper(F.btrim(F.col("op"), F.lit(BLANKS)))
    made = F.when(op.isin("CREATE", "0"), True).when(op.isin("DELETE", "1"), False)
    rows = log.select("seq", "table_id", "level", "key_id", made.alias("created")).where("created is not null and seq is not null and table_id is not null")
    one = Window.partitionBy("seq").orderBy("table_id", "level", "key_id")
    return rows.withColumn("_copy", F.row_number().over(one)).where("_copy = 1").drop("_copy")


def state(log: DataFrame) -> DataFrame:
    """(table_id, level, key_id, seq): the tables whose last change creates them, as it says."""
    last = Window.partitionBy("table_id").orderBy(F.desc("seq"))
    rows = changes(log).withColumn("_rank", F.row_number().over(last)).where("_rank = 1 and created")
    return rows.select("table_id", "level", "key_id", "seq")


def errors(log: DataFrame) -> DataFrame:
    """(seq, table_id, error): changes that a strict fold refuses: creating what exists, deleting what doesn't."""
    order = Window.partitionBy("table_id").orderBy("seq")
    rows = changes(log).withColumn("_was", F.coalesce(F.lag("created").over(order), F.lit(False)))
    error = F.when(F.col("created") & F.col("_was"), "exists").when(~F.col("created") & ~F.col("_was"), "missing")
    return rows.withColumn("error", error).where("error is not null").select("seq", "table_id", "error")


def counts(log: DataFrame) -> DataFrame:
    """One row: creations, deletions, tables that exist."""
    last = Window.partitionBy("table_id").orderBy(F.desc("seq"))
    rows = changes(log).withColumn("_rank", F.row_number().over(last))
    return rows.agg(F.count_if("created").alias("creations"), F.count_if(~F.col("created")).alias("deletions"), F.count_if(F.col("created") & (F.col("_rank") == 1)).alias("tables"))


def tables(info: DataFrame) -> DataFrame:
    """Each table's row once: of several the one with the most keys, then the greatest of the other columns."""
    others = [c for c in info.columns if c not in ("table_id", "key_count")]
    order = Window.partitionBy("table_id").orderBy(F.desc("key_count"), *[F.desc(c) for c in others])
    return info.where("table_id is not null").withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def in_order(info: DataFrame) -> DataFrame:
    """All tables by level; in level 0 by id, below by smallest key."""
    return tables(info).orderBy("level", F.when(F.col("level") == 0, F.col("table_id")), "smallest", "table_id")


def levels(info: DataFrame) -> DataFrame:
    """Per level: tables, keys, bytes, highest version, next table id."""
    return tables(info).groupBy("level").agg(
        F.count("*").alias("n_tables"),
        F.sum("key_count").alias("key_count"),
        F.sum("on_disk_size").alias("on_disk_size"),
        F.max("max_version").alias("max_version"),
        (F.max("table_id") + 1).alias("next_id"),
    )


def overlaps(info: DataFrame) -> DataFrame:
    """(level, table_id, error): tables below level 0 that begin at or before the end of the one before ('overlap')
    or after their own end ('inverted'). All levels are ordered together, by ranges, as one may have most tables."""
    order = ["level", "smallest", ranges.By("smallest_ver", True), "table_id"]
    rows = tables(info).where("level > 0").select("level", "table_id", "smallest", "smallest_ver", "biggest")
    rows = ranges.before(rows, order, F.struct("level", "biggest"))
    last = F.when(F.col("_prior.level") == F.col("level"), F.col("_prior.biggest"))
    error = F.when(last >= F.col("smallest"), "overlap").when(F.col("smallest") > F.col("biggest"), "inverted")
    return rows.withColumn("error", error).where("error is not null").select("level", "table_id", "error")


def missing_on_disk(log: DataFrame, info: DataFrame) -> DataFrame:
    """(table_id, level): tables of the manifest that aren't there: an error on opening."""
    return state(log).join(tables(info).select("table_id"), "table_id", "left_anti").select("table_id", "level")


def orphans(log: DataFrame, info: DataFrame) -> DataFrame:
    """(table_id, level): tables that the manifest doesn't know: to be deleted."""
    return tables(info).join(state(log).select("table_id"), "table_id", "left_anti").select("table_id", "level")


def remaining_files(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """(fid): log files without those to be deleted, ascending."""
    return files.select("fid").distinct().join(deleted.select("fid"), "fid", "left_anti").orderBy("fid")


def table_meta(log: DataFrame, value_size: Column) -> DataFrame:
    """Per table of the entries flushed to it: keys, highest version, first and last place, bytes of values."""
    place = F.struct("user_key", (-F.col("version")).alias("v"))
    rows = log.where("table_id is not null").groupBy("table_id").agg(
        F.count("*").alias("key_count"), F.max("version").alias("max_version"), F.sum(value_size).alias("value_bytes"), F.min(place).alias("a"), F.max(place).alias("b")
    )
    return rows.select(
        "table_id", "key_count", "max_version", "value_bytes", F.col("a.user_key").alias("smallest"), (-F.col("a.v")).alias("smallest_ver"), F.col("b.user_key").alias("biggest"), (-F.col("b.v")).alias("biggest_ver")
    )
