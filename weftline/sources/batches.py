"""Arrow batches in pieces, so that what Python holds of a batch does not grow with its rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes, as Arrow holds them, that become Python objects at a time; these take some ten times as many.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices, in order, of at most so many bytes, or of one row. An empty batch has none."""
    if not batch.num_rows:
        return
    rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for begin in range(0, batch.num_rows, rows):
        part = batch.slice(begin, rows)
        # rows of a batch may differ much
        if part.num_rows > 1 and part.nbytes > 2 * most:
            half = part.num_rows // 2
            yield from pieces(part.slice(0, half), most)
            yield from pieces(part.slice(half), most)
        else:
            yield part


def in_pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, most)
