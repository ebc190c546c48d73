"""Arrow batches in portions, so that a worker's memory follows `CHARS` and the longest text, not the rows of a batch."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows are taken together up to so many bytes of text.
CHARS = 500_000


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most `CHARS` together, or of one alone."""
    at = 0
    while at < len(sizes):
        end, size = at + 1, sizes[at]
        while end < len(sizes) and size + sizes[end] <= CHARS:
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions by the size of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in portions(sizes.tolist()):
        yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column one by one, in portions."""
    for some in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0):
        yield from some.column(0).to_pylist()
