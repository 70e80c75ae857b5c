"""Checksums of blocks and tables, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import crc32c

MODES = ("none", "table", "block", "both")


def block_sums(entries: DataFrame) -> DataFrame:
    """(table_id, block, data, crc) of (table_id, block, begins, entry): the entries of each block in order, and CRC32C of them.

    A block is bounded by its size, so its entries may be gathered.
    """
    parts = F.array_sort(F.collect_list(F.struct("begins", F.hex("entry").alias("e"))))
    blocks = entries.groupBy("table_id", "block").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["e"]), "")).alias("data"))
    return blocks.withColumn("crc", crc32c("data"))


def summed(blocks: DataFrame) -> DataFrame:
    """(table_id, block, data) of `greedy.laid_out` with `crc`: CRC32C of all that a block holds before its checksum."""
    return blocks.withColumn("crc", crc32c("data"))


def table_sums(blocks: DataFrame) -> DataFrame:
    """(table_id, blocks, crc): the number of a table's blocks and a sum of their checksums that doesn't depend on their order."""
    return blocks.groupBy("table_id").agg(F.count("*").alias("blocks"), F.bit_xor(F.xxhash64("block", "crc")).alias("crc"))


def broken(blocks: DataFrame, tables: DataFrame, mode: str) -> DataFrame:
    """(table_id, block): blocks whose data doesn't give their checksum, and tables, with a null block, whose blocks
    don't give theirs. `mode` says what is looked at: none, table, block or both."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    none = blocks.select("table_id", "block").limit(0)
    bad = blocks.where(~crc32c("data").eqNullSafe(F.col("crc"))).select("table_id", "block") if mode in ("block", "both") else none
    if mode in ("table", "both"):
        found = table_sums(blocks).select("table_id", F.col("blocks").alias("_n"), F.col("crc").alias("_c"))
        same = F.col("_n").eqNullSafe(F.col("blocks")) & F.col("_c").eqNullSafe(F.col("crc"))
        bad = bad.unionByName(tables.join(found, "table_id", "left").where(~same).select("table_id", F.lit(None).cast(none.schema["block"].dataType).alias("block")))
    return bad
