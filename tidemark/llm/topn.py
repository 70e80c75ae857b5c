"""The highest-scoring items of every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changed(column: pa.Array, prior) -> np.ndarray:
    """Whether each value differs from the one before it; nulls equal each other."""
    before = pa.concat_arrays([pa.array([prior], type=column.type), column.slice(0, len(column) - 1)])
    both_null = pc.and_(pc.is_null(column), pc.is_null(before))
    differ = pc.fill_null(pc.not_equal(column, before), True)
    return pc.and_not(differ, both_null).to_numpy(zero_copy_only=False)


def first_n(n: int):
    """A function over Arrow batches sorted by (group, score desc, item desc): the first n items of each group.

    Only the last row and the number of items kept of its group pass from batch to batch,
    so no group is ever held in memory. Equal neighbours are one item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        held = 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            columns = [batch.column(i) for i in range(3)]
            prior = last or [None, None, None]
            new_group = _changed(columns[0], prior[0])
            if last is None:
                new_group[0] = True
            new_item = new_group | _changed(columns[1], prior[1]) | _changed(columns[2], prior[2])
            count = np.cumsum(new_item)
            starts = np.flatnonzero(new_group)
            # items counted before the group began; the group that goes on from the last batch has `held`
            base = np.concatenate([[-held], count[starts] - 1])
            rank = count - base[np.searchsorted(starts, np.arange(size), side="right")]
            keep = new_item & (rank <= n)
            held = int(rank[-1])
            last = [c[size - 1].as_py() for c in columns]
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: str, score: str, item: str, n: int = 3) -> DataFrame:
    """(group, score, item): the n distinct items of highest score of each group, the higher item first among equals.

    All of a group's items if there are fewer. Rows with a null group or score don't count;
    rows equal in all three columns are one item, and a null item sorts last. Other columns
    are not read. An empty table gives no rows.

    Each input partition is sorted and cut to n items a group before the shuffle, so a
    group of any size reaches its task as at most n rows a partition; after the shuffle by
    group the same sorted stream cuts again.
    """
    rows = df.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(item).alias("i")).where("g is not null and s is not null")
    order = [F.col("g"), F.col("s").desc_nulls_last(), F.col("i").desc_nulls_last()]
    local = rows.sortWithinPartitions(*order).mapInArrow(first_n(n), rows.schema)
    found = local.repartition("g").sortWithinPartitions(*order).mapInArrow(first_n(n), rows.schema)
    return found.select(F.col("g").alias(group), F.col("s").alias(score), F.col("i").alias(item))
