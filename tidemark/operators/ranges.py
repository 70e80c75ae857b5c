"""Global order without a single task: ranges with fixed bounds, and a bounded table of their ends.

The bounds are sampled once and stand in the plan as literals, so a row's range is a function of
the row: it is the same wherever the plan computes it, whatever columns are pruned, whether
exchanges are reused or not, and when a lost task runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import partitions

#: Rows of the sample for each range, and ranges at most: together they bound what the driver gets.
SAMPLED, MOST_RANGES = 40, 4096
_SEED = 11


class By(NamedTuple):
    """A column to order by; one that descends is a number. Nulls come first if it ascends, last if it descends, as in Spark."""

    name: str
    descending: bool = False

    def sort(self) -> Column:
        return F.desc(self.name) if self.descending else F.asc(self.name)


def _by(order: Sequence[str | By]) -> list[By]:
    return [o if isinstance(o, By) else By(o) for o in order]


def place_in(bounds: Column, most: int, reached: Callable[[Column], Column]) -> Column:
    """How many elements of a sorted array of at most `most` a row has reached: a binary search.

    `reached` of an element must hold for a leading run of the array only.
    """
    steps = [1 << k for k in reversed(range(max(1, most.bit_length())))]

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= F.size(bounds)) & reached(F.try_element_at(bounds, to)), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _not_before(row: Callable[[str], Column], bound: Column, order: list[By]) -> Column:
    """Whether a row stands at or behind a bound in the order."""
    out = F.lit(True)
    for o in reversed(order):
        a, b = row(o.name), bound[o.name]
        behind = a < b if o.descending else a > b
        ahead_null = b.isNotNull() & a.isNull() if o.descending else a.isNotNull() & b.isNull()
        out = F.coalesce(behind, F.lit(False)) | ahead_null | (a.eqNullSafe(b) & out)
    return out


def bounds(df: DataFrame, order: Sequence[str | By], n: int) -> list:
    """At most n - 1 rows of `df` that cut it into ranges of about equal numbers of rows: quantiles of a sample.

    About SAMPLED rows a range come to the driver, of the columns of the order alone. Many
    equal rows make fewer bounds.
    """
    keys = _by(order)
    rows = df.select(*[o.name for o in keys])
    total = rows.count()
    if n < 2 or not total:
        return []
    fraction = min(1.0, SAMPLED * n / total)
    sample = (rows.sample(fraction, _SEED) if fraction < 1 else rows).orderBy(*[o.sort() for o in keys]).collect()
    picked = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    return [r for i, r in enumerate(picked) if not i or r != picked[i - 1]]


def placed(df: DataFrame, order: Sequence[str | By], n: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """`df` with `_part`, the number of the row's range in the order, from 0 on.

    The bounds are those of `of`, or of `df` itself; any table with the columns of the order
    can be placed by them.
    """
    keys = _by(order)
    source = df if of is None else of
    at = bounds(source, keys, min(n or 4 * partitions(df.sparkSession), MOST_RANGES))
    return df.withColumn("_part", part_of(at, keys, source))


def part_of(at: list, order: Sequence[str | By], source: DataFrame) -> Column:
    """The number of the range, by bounds of `bounds` over `source`, of a row with the columns of the order."""
    keys = _by(order)
    if not at:
        return F.lit(0)
    kinds = {o.name: source.schema[o.name].dataType for o in keys}
    literal = F.array(*[F.struct(*[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(kinds[o.name]).alias(o.name) for o, v in zip(keys, row)]) for row in at])
    return place_in(literal, len(at), lambda b: _not_before(F.col, b, keys))


def before(df: DataFrame, order: Sequence[str | By], value: Column) -> DataFrame:
    """`df` with `_prior`: `value` of the row before in the order, null for the first. `value` is a struct,
    so that its own nulls aren't taken for none. `order` is total.

    A lag within each range; a range's first row takes the last value of the ranges before
    it, from a table with one row each.
    """
    rows = placed(df, order).withColumn("_value", value)
    sort = [o.sort() for o in _by(order)]
    rows = rows.withColumn("_lag", F.lag("_value").over(Window.partitionBy("_part").orderBy(*sort)))
    place = F.struct(*[c for o in _by(order) for c in ((F.col(o.name).isNull(), -F.col(o.name)) if o.descending else (F.col(o.name),))])
    ends = rows.groupBy(F.col("_part").alias("_after")).agg(F.max_by("_value", place).alias("_end"))
    # at most one row a range, here and below
    beyond = Window.partitionBy(F.lit(0)).orderBy("_after")
    carry = ends.select((F.lead("_after").over(beyond)).alias("_part"), F.col("_end").alias("_carry")).where("_part is not null")
    return rows.join(F.broadcast(carry), "_part", "left").withColumn("_prior", F.coalesce("_lag", "_carry")).drop("_part", "_value", "_lag", "_carry")


def numbered(df: DataFrame, order: Sequence[str | By], name: str, first: int = 0, of: DataFrame | None = None) -> DataFrame:
    """`df` with `name`: each row's place in the order, from `first` on. `order` is total.

    Sizes of ranges are counted before any exchange; the rows are exchanged once. `of`: a
    table to take the bounds from where `df` is dear to compute.
    """
    rows = placed(df, order, of=of)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*[o.sort() for o in _by(order)]))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_inside") + F.col("_offset") - 1 + first).cast("long")).drop("_part", "_inside", "_offset")
