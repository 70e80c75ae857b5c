"""Applying a change feed: a signed multiset of row images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import BLANKS, partitions


def _images(df: DataFrame, keys: list[str], deleted: str, chunk: list[str], tombstones: bool) -> DataFrame:
    """The images that remain of each chunk of a key's changes.

    A change takes the image before it out of the multiset (-1) and puts its own in
    (+1); the sum over a chunk leaves its last image alone. A delete's image is a
    tombstone: it stays while chunks are still to be merged, and is nothing at the end.
    The sum groups by more columns than the window, so it needs no exchange of its own.
    """
    by = [*keys, *chunk]
    seen = Window.partitionBy(*by).orderBy("_version", "_seq")
    own = F.struct(F.lit(1).alias("sign"), F.col("_version").alias("v"), F.col("_seq").alias("s"), F.col(deleted).alias("d"))
    before = F.struct(F.lit(-1).alias("sign"), F.col("_pv").alias("v"), F.col("_ps").alias("s"), F.col("_pd").alias("d"))
    signed = (
        df.withColumn("_again", F.coalesce((F.lag("_version").over(seen) == F.col("_version")) & F.lag("_seq").over(seen).eqNullSafe(F.col("_seq")), F.lit(False)))
        .where(~F.col("_again"))
        .withColumns({"_pv": F.lag("_version").over(seen), "_ps": F.lag("_seq").over(seen), "_pd": F.lag(deleted).over(seen)})
        .select(*by, F.explode(F.array(own, before)).alias("_i"))
        .where(F.col("_i.v").isNotNull())
        .select(*by, "_i.*")
    )
    if not tombstones:
        signed = signed.where(~F.col("d"))
    return (
        signed.groupBy(*by, F.col("v").alias("_version"), F.col("s").alias("_seq"), F.col("d").alias(deleted))
        .agg(F.sum("sign").alias("_n"))
        .where("_n > 0")
        .drop("_n")
    )


def apply_changes(changes: DataFrame, keys: list[str], version: Column, seq: Column, deleted: Column, base: DataFrame | None = None, salts: int | None = None) -> DataFrame:
    """State after all changes: one row (keys, seq) for each key that exists.

    Changes may repeat and come in any order. They are ordered by `version`, then `seq`
    (null `seq` first); rows with equal keys, version and seq are one change. Rows with a
    null key column or null version are no changes. `base` has (keys, version, seq) of
    the state before them; it takes part as earlier images. Empty input gives no rows.

    Two steps, as sums are associative: first within (key, salt), so that a key with a
    third of all rows is spread over `salts` tasks (by default the shuffle's width, 64 at
    least); then over the at most `salts` images that each key has left. The salt is of
    the seq and the input partition: copies of one change are spread too, and what is
    left of them meets in the second step, which drops repeats as the first does.
    """
    salts = salts or max(64, partitions(changes.sparkSession))
    rows = changes.select(*keys, version.alias("_version"), seq.alias("_seq"), F.coalesce(deleted, F.lit(False)).alias("_deleted"))
    if base is not None:
        rows = rows.unionByName(base.select(*keys, F.col("version").alias("_version"), F.col("seq").alias("_seq"), F.lit(False).alias("_deleted")))
    for k in [*keys, "_version"]:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col("_seq"), F.spark_partition_id()), F.lit(salts)))
    parts = _images(rows, keys, "_deleted", ["_salt"], tombstones=True)
    return _images(parts.drop("_salt"), keys, "_deleted", [], tombstones=False).select(*keys, F.col("_seq").alias("seq"))


def kv_state(feed: DataFrame, salts: int | None = None) -> DataFrame:
    """Keys that exist after a feed of KV messages: ('kv', key as text, seq of the last change).

    A message with bit DELETE in its one-byte `meta` deletes; null or empty meta has no bit.
    Null or empty keys and null versions are no changes; expiry is ignored.
    """
    real = feed.where(F.col("key").isNotNull() & (F.octet_length("key") > 0) & F.col("version").isNotNull())
    bits = F.when(F.octet_length("meta") > 0, F.conv(F.hex(F.substring("meta", 1, 1)), 16, 10).cast("int")).otherwise(0)
    state = apply_changes(real, ["key"], F.col("version"), F.col("seq"), bits.bitwiseAND(1) == 1, salts=salts)
    return state.select(F.lit("kv").alias("kind"), F.col("key").cast("string").alias("name"), "seq")


def table_state(log: DataFrame, salts: int = 8) -> DataFrame:
    """Tables that exist after a manifest log: ('table', id in decimal, seq of the last change).

    `op` is CREATE or DELETE in any case, padded or not, or 0 or 1; any other is no change.
    """
    op = F.upper(F.btrim(F.col("op"), F.lit(BLANKS)))
    kind = F.when(op.isin("CREATE", "0"), False).when(op.isin("DELETE", "1"), True)
    real = log.withColumn("_gone", kind).where(F.col("_gone").isNotNull() & F.col("seq").isNotNull())
    state = apply_changes(real, ["table_id"], F.col("seq"), F.col("seq"), F.col("_gone"), salts=salts)
    return state.select(F.lit("table").alias("kind"), F.col("table_id").cast("string").alias("name"), "seq")
