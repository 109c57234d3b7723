"""Arrow batches in and out of Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of a string column, so that what is held beside a batch is bounded."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for i, j in slices(b, sizes, limit):
            yield b.slice(i, j - i)


def slices(batch: pa.RecordBatch, sizes: list[int], limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, so that what a kernel allocates is bounded."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
