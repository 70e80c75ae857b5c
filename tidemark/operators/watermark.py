"""The transactions that are certainly over."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from threading import Condition

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(marks: DataFrame) -> DataFrame:
    """(name, idx, open): how many begins of each index aren't done yet; only those above 0."""
    change = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "done", -1).otherwise(0)
    return marks.where("idx is not null").groupBy("name", "idx").agg(F.sum(change).alias("open")).where("open > 0")


def low_watermark(marks: DataFrame) -> DataFrame:
    """(name, done_until): per name the largest index such that every begun index up to it is done; 0 if none.

    Only aggregates: sums by index, then a minimum and a maximum by name, each combined
    before its shuffle.
    """
    change = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "done", -1).otherwise(0)
    each = marks.where("idx is not null").groupBy("name", "idx").agg(F.sum(change).alias("open"))
    first_open = each.groupBy("name").agg(F.min(F.when(F.col("open") > 0, F.col("idx"))).alias("_first"))
    done = each.where("open <= 0").join(first_open, "name").where("_first is null or idx < _first")
    until = done.groupBy("name").agg(F.max("idx").alias("_until"))
    return first_open.join(until, "name", "left").select("name", F.coalesce("_until", F.lit(0)).cast("long").alias("done_until"))


class Watermark:
    """The same mark for transactions of this process, begun and ended one by one by any thread."""

    def __init__(self, until: int = 0):
        self._until, self._last = until, until
        self._open: Counter[int] = Counter()
        self._over: list[int] = []
        self._moved = Condition()

    def begin(self, *indexes: int) -> None:
        """Indexes that are open from now on; one may be begun more than once."""
        with self._moved:
            self._open.update(indexes)
            self._last = max(self._last, *indexes)

    def done(self, *indexes: int) -> None:
        """Ends an index as often as it was begun."""
        with self._moved:
            for i in indexes:
                self._open[i] -= 1
                if self._open[i] <= 0:
                    del self._open[i]
                    insort(self._over, i)
            lowest = min(self._open, default=None)
            below = len(self._over) if lowest is None else bisect_left(self._over, lowest)
            if below:
                self._until = max(self._until, self._over[below - 1])
                del self._over[:below]
                self._moved.notify_all()

    @property
    def done_until(self) -> int:
        """The largest index up to which all that were begun are done."""
        return self._until

    @property
    def lowest_open(self) -> int | None:
        """The lowest open index; None if none is."""
        with self._moved:
            return min(self._open, default=None)

    def wait(self, index: int, timeout: float | None = None) -> bool:
        """Waits until all up to an index are done; False if the time is over before."""
        with self._moved:
            return self._moved.wait_for(lambda: self._until >= index, timeout)
