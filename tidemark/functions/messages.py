"""KV messages in wire form: a change feed as protocol buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import varint

# The numbers of a message's fields, of bytes and of numbers.
BYTES = {"key": 1, "value": 2, "user_meta": 3, "meta": 6}
NUMBERS = {"version": 4, "expires_at": 5, "stream_id": 10, "stream_done": 11}
#: Fixed value: the field of a list that each message of it is in.
IN_LIST = 1


def _tag(number: int, kind: int) -> Column:
    return F.lit(bytes([number << 3 | kind]))


def bytes_field(number: int, data: Column) -> Column:
    """A field of bytes; nothing if they are null or empty."""
    return F.when(F.octet_length(data) > 0, F.concat(_tag(number, 2), varint(F.octet_length(data).cast("long")), data)).otherwise(F.lit(b""))


def number_field(number: int, value: Column) -> Column:
    """A field of a number that is not negative; nothing if it is null or 0."""
    value = value.cast("long")
    return F.when(value > 0, F.concat(_tag(number, 0), varint(value))).otherwise(F.lit(b""))


def kv() -> Column:
    """The message of a row of a feed (key, value, user_meta, version, expires_at, meta, stream_id, stream_done)."""
    fields = {n: bytes_field(n, F.col(c)) for c, n in BYTES.items()} | {n: number_field(n, F.col(c)) for c, n in NUMBERS.items()}
    return F.concat(*[fields[n] for n in sorted(fields)])


def kv_list(messages: Column) -> Column:
    """A list message of an array of messages."""
    return F.aggregate(messages, F.lit(b""), lambda acc, m: F.concat(acc, _tag(IN_LIST, 2), varint(F.octet_length(m).cast("long")), m))


def _values(data: bytes) -> tuple:
    from tidemark.sources.binary import message

    found = dict(message(data))
    numbers = [min(found.get(n, 0), (1 << 63) - 1) for n in NUMBERS.values()]
    return *(found.get(n, b"") for n in BYTES.values()), *numbers[:3], bool(numbers[3])


_KINDS = [*([pa.binary()] * 4), *([pa.int64()] * 3), pa.bool_()]
_SCHEMA = ", ".join([*(f"{c} binary" for c in BYTES), *(f"{c} long" for c in list(NUMBERS)[:3]), "stream_done boolean"])


def read_kv(rows: DataFrame, column: str, listed: bool = False) -> DataFrame:
    """The rows with the fields of the KV message in a column in its place; with `listed`, a row for each message of a list.

    Absent fields are empty, 0 or false; unknown ones are left out. A null message is an
    empty one; what is no message is an error. Other columns with the fields' names are dropped.
    """
    own = [f.name for f in rows.schema if f.name != column and f.name not in (*BYTES, *NUMBERS)]
    taken = rows.select(*own, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema if f.name != column), _SCHEMA])
    names = [*own, *BYTES, *NUMBERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.sources.binary import message

        for batch in batches:
            at, made = [], []
            for i, data in enumerate(batch.column(len(own)).to_pylist()):
                parts = [m for n, m in message(data or b"") if n == IN_LIST] if listed else [data or b""]
                at += [i] * len(parts)
                made += map(_values, parts)
            columns = [pa.array(c, k) for c, k in zip(zip(*made), _KINDS)] if made else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(own))), *columns], names)

    return taken.mapInArrow(run, schema)
