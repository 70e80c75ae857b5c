"""Greedy cuts of ordered streams: a segment ends when the next or last item is too much for it.

The state is reset at each cut, so no window function can say it. Rows are partitioned by
group, sorted and streamed: a group of any size passes through one row's worth of state.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bytes before a value file's first entry.
FILE_HEAD = 20
#: A step gets (state or None for a new group, the values of a row) and gives (new state, values of the new columns).
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def streamed(df: DataFrame, group: str, order: list[str], values: list[str], step: Step, schema: str) -> DataFrame:
    """`df` with columns that a step computes from row to row, in order within each group.

    `schema` gives names and types of the new columns. Ties in `order` come in no defined
    order: give a total one. A null group is a group.
    """
    rows = df.repartition(group).sortWithinPartitions(group, *order)
    new = [c.strip().rsplit(" ", 1)[0].strip("`") for c in schema.split(",")]
    names = df.columns
    at_group, at = names.index(group), [names.index(v) for v in values]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + schema
    kinds = [f.type for f in _arrow(df, schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = None, None, False
        for batch in batches:
            groups = batch.column(at_group).to_pylist()
            columns = [batch.column(i).to_pylist() for i in at]
            made: list[tuple] = []
            for g, *row in zip(groups, *columns):
                if not begun or g != last:
                    state, last, begun = None, g, True
                state, extra = step(state, tuple(row))
                made.append(extra)
            added = [pa.array(c, k) for c, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *new])

    return rows.mapInArrow(run, out)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def rotate(limit: int) -> Step:
    """(segment, offset): a segment is full once its bytes reach the limit; the next row starts a new one."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        segment, used = state or (0, 0)
        if used >= limit:
            segment, used = segment + 1, 0
        return (segment, used + row[0]), (segment, used)

    return step


def value_files(limit_bytes: int, limit_entries: int, first_offset: int = FILE_HEAD) -> Step:
    """(file, offset) of values written to log files: a new file once one is over its bytes or the entries
    written since the last change of file are over their number."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        file, offset, n = state or (1, first_offset, 0)
        size = row[0]
        here = (file, offset)
        offset, n = offset + size, n + 1
        if offset > limit_bytes or n > limit_entries:
            file, offset, n = file + 1, first_offset, 0
        return (file, offset, n), here

    return step


def requests(limit: int, most: int = (1 << 32) - 1) -> Step:
    """(offset, too_big): the estimated log offset before each request, which starts over once at the file's size;
    and whether the request goes beyond what an offset can say."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (offset,) = state or (0,)
        end = offset + row[0]
        return (0 if end >= limit else end,), (offset, end > most)

    return step


def blocks(block_size: int = 4096) -> Step:
    """(block, base_key, overlap, lcp, begins): block of a sorted table that an entry (key, stored value's bytes) goes to.

    An entry starts a new block if the block would be too large with it: its bytes so far,
    6 for the header, key, value, and 4 for each offset and 16 for list and checksum. Keys
    after a block's first leave out what they share with it: `overlap` bytes (nothing if
    one is a prefix of the other), where `lcp` are shared.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        key, size = row
        block, base, end, n = state or (0, None, 0, 0)
        if n and end + 6 + len(key) + size + (n + 1) * 4 + 16 > block_size:
            block, base, end, n = block + 1, None, 0, 0
        if base is None:
            base, lcp, left = key, 0, 0
        else:
            short = min(len(base), len(key))
            lcp = next((i for i in range(short) if base[i] != key[i]), short)
            left = lcp if lcp < short else 0
        return (block, base, end + 4 + len(key) - left + size, n + 1), (block, base, left, lcp, end)

    return step


def laid_out(df: DataFrame, group: str, order: list[str], key: str, stored: str, block_size: int = 4096) -> DataFrame:
    """(group, block, data): each group's blocks as a table file holds them up to their checksum.

    Of each entry the header (bytes shared with the block's first key and bytes left of the
    key, two little-endian bytes each), the rest of the key and the stored value; then the
    entries' offsets and their number, four big-endian bytes each. A group is streamed in
    `order`, a total one; no more than a block of it is held.
    """
    rows = df.select(*dict.fromkeys([group, *order, key, stored])).repartition(group).sortWithinPartitions(group, *order)
    at_group, at_key, at_stored = (rows.columns.index(c) for c in (group, key, stored))
    step = blocks(block_size)
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, block long, data binary"
    kinds = [f.type for f in _arrow(df, schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun, block = None, None, False, 0
        parts: list[bytes] = []
        starts: list[int] = []
        made: list[tuple] = []

        def close() -> None:
            if starts:
                made.append((last, block, b"".join([*parts, struct.pack(f">{len(starts) + 1}I", *starts, len(starts))])))
                parts.clear()
                starts.clear()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [group, "block", "data"])
            made.clear()
            return out

        for batch in batches:
            for g, k, v in zip(*(batch.column(i).to_pylist() for i in (at_group, at_key, at_stored))):
                if not begun or g != last:
                    close()
                    state, last, begun = None, g, True
                state, (number, _, shared, _, begins) = step(state, (k, len(v)))
                if not begins:
                    close()
                    block = number
                starts.append(begins)
                parts += struct.pack("<HH", shared, len(k) - shared), k[shared:], v
            if made:
                yield batch_of()
        close()
        if made:
            yield batch_of()

    return rows.mapInArrow(run, schema)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with `row_no`, from 0 in each group, streamed."""
    return streamed(df.withColumn("_one", F.lit(1)), group, order, ["_one"], lambda s, r: (((s or (0,))[0] + 1,), ((s or (0,))[0],)), "row_no long").drop("_one")
