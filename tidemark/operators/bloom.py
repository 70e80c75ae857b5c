"""Bloom filters of tables as rows of 32-bit words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import bloom_bits_per_key, bloom_hash, bloom_positions, bloom_probes, bloom_size


def filter_sizes(keys: DataFrame, rate: float) -> DataFrame:
    """(table_id, n, bits, probes): the shape of each table's filter, by its number of entries."""
    n = keys.groupBy("table_id").agg(F.count("*").alias("n"))
    per_key = bloom_bits_per_key(F.col("n"), rate)
    return n.select("table_id", "n", bloom_size(F.col("n"), per_key).alias("bits"), bloom_probes(per_key).alias("probes"))


def build(keys: DataFrame, shapes: DataFrame) -> DataFrame:
    """(table_id, word, mask): the words of each filter that have a bit. Keys' bits are combined before the shuffle."""
    placed = keys.select("table_id", bloom_hash(F.col("user_key")).alias("h")).distinct().join(shapes, "table_id")
    bits = placed.select("table_id", F.explode(bloom_positions(F.col("h"), F.col("probes"), F.col("bits"))).alias("bit"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int")))
    return bits.groupBy("table_id", F.floor(F.col("bit") / 32).alias("word")).agg(mask.alias("mask"))


def probe(pairs: DataFrame, filters: DataFrame, shapes: DataFrame) -> DataFrame:
    """(table_id, user_key, maybe): whether each table may have each key.

    A table without a filter may have any. Pairs meet the words they ask for, so a filter
    of any size is spread over its words.
    """
    shape = shapes.select("table_id", "bits", "probes")
    asked = pairs.select("table_id", "user_key").distinct().join(shape, "table_id", "left").withColumn("h", bloom_hash(F.col("user_key")))
    bits = asked.select("table_id", "user_key", F.explode_outer(F.when(F.col("bits").isNotNull(), bloom_positions(F.col("h"), F.col("probes"), F.col("bits")))).alias("bit"))
    words = bits.withColumn("word", F.floor(F.col("bit") / 32)).join(filters, ["table_id", "word"], "left")
    lit = F.call_function("shiftright", F.coalesce("mask", F.lit(0).cast("long")), (F.col("bit") % 32).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return words.groupBy("table_id", "user_key").agg(F.bool_and(F.coalesce(F.col("bit").isNull() | lit, F.lit(True))).alias("maybe"))


def false_positive_rate(answers: DataFrame, members: DataFrame) -> DataFrame:
    """One row: pairs asked that are no members, wrong answers, their rate, and members that were denied (0)."""
    known = members.select("table_id", "user_key").distinct().withColumn("_in", F.lit(True))
    rows = answers.join(known, ["table_id", "user_key"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    total = rows.agg(F.count_if(~F.col("_in")).alias("absent"), F.count_if(~F.col("_in") & F.col("maybe")).alias("wrong"), F.count_if(F.col("_in") & ~F.col("maybe")).alias("denied"))
    return total.withColumn("rate", F.when(F.col("absent") > 0, F.round(F.col("wrong") / F.col("absent"), 6)).otherwise(0.0))
