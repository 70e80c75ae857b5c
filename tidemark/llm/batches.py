"""Arrow batches of texts in slices that bound what Python holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows, and bytes of texts, of a slice; a single text may be longer.
ROWS = 512
BYTES = 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of at most ROWS rows and, but for single rows, about BYTES of texts."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            rows = min(ROWS, n - at)
            while rows > 1 and batch.column(column).slice(at, rows).nbytes > BYTES:
                rows = (rows + 1) // 2
            yield batch.slice(at, rows)
            at += rows
