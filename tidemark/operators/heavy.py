"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import MOST_RANGES, place_in
from tidemark.sources.tables import has_key, partitions

#: Rows of the sample for each task's share of the rows.
SAMPLED = 400


def heavy_keys(df: DataFrame, key: str, value: str, shares: int, sampled: int = SAMPLED, seed: int = 7) -> DataFrame:
    """(key, bounds): the keys that hold at least half of a share, 1/shares of all rows, and the quantiles of their
    values that cut them into pieces of about a share.

    Found in a sample of about `sampled` rows a share, whatever the size of the table: at
    most 2 x shares keys and 3 x shares bounds come out. A key missed or added by the
    sample changes the plan, never the result.
    """
    total = df.count()
    fraction = min(1.0, sampled * shares / total) if total else 1.0
    sample = df.select(F.col(key).alias("key"), F.col(value).alias("value")).sample(fraction, seed).where("key is not null and value is not null")
    drawn = max(1.0, total * fraction)
    each = sample.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("value")).alias("v")).where(F.col("n") >= drawn / (2 * shares))
    pieces = F.ceil(F.col("n") * shares / drawn)
    cut = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.element_at("v", F.floor(i * F.col("n") / pieces).cast("int") + 1))
    return each.select("key", F.when(pieces > 1, cut).otherwise(F.slice("v", 1, 0)).alias("bounds"))


def _best(step: Column, low: Column, to: Column) -> Column:
    """The longest of steps above 0, the lowest among equal ones."""
    return F.max(F.when(step > 0, F.struct(step.alias("step"), (-low).alias("low"), to.alias("to"))))


def longest_step(changes: DataFrame, key: str = "key", version: str = "version", shares: int | None = None, sampled: int = SAMPLED) -> DataFrame:
    """(key, from_version, to_version): the neighbouring distinct versions of a key that lie furthest apart.

    Keys with fewer than two distinct versions have no row; null or empty keys and null
    versions are left out; among equal steps the lowest counts. Repeated versions give
    steps of 0, which are no steps. Versions are not negative, so that no step overflows.

    Heavy keys, found in a sample, are joined by broadcast to the quantiles of their
    versions (at most three bounds a share, four shares a task of the shuffle, MOST_RANGES
    shares at most) and so cut into pieces of about a share; all others have one piece.
    Both then go through one exchange by (key, piece), which is their union: one scan after
    the sample. A version that fills several pieces alone is spread over them by input
    partition, so its copies are no hot group. Steps are taken within pieces, and between
    the ends of neighbouring ones from one row a piece.
    """
    rows = changes.where(has_key(key) & F.col(version).isNotNull()).select(F.col(key).alias("key"), F.col(version).alias("version"))
    shares = shares or min(4 * partitions(changes.sparkSession), MOST_RANGES)
    heavy = heavy_keys(changes, key, version, shares, sampled)
    low = place_in(F.col("bounds"), shares, lambda b: b < F.col("version"))
    high = place_in(F.col("bounds"), shares, lambda b: b <= F.col("version"))
    # any piece from the first to the last that the version bounds will do, as order within and between them is kept
    spread = low + F.pmod(F.hash(F.spark_partition_id()), high - low + 1)
    pieces = rows.join(F.broadcast(heavy), "key", "left").select("key", "version", F.when(F.size("bounds") > 0, spread).otherwise(0).alias("piece"))
    within = F.lag("version").over(Window.partitionBy("key", "piece").orderBy("version"))
    ends = pieces.withColumn("prior", within).groupBy("key", "piece").agg(
        _best(F.col("version") - F.col("prior"), F.col("prior"), F.col("version")).alias("best"), F.min("version").alias("first"), F.max("version").alias("last")
    )
    before = F.lag("last").over(Window.partitionBy("key").orderBy("piece"))
    across = _best(F.col("first") - F.col("before"), F.col("before"), F.col("first"))
    found = ends.withColumn("before", before).groupBy("key").agg(F.max("best").alias("a"), across.alias("b"))
    best = F.greatest("a", "b")
    return found.where("a is not null or b is not null").select("key", (-best["low"]).alias("from_version"), best["to"].alias("to_version"))
