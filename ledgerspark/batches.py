"""Arrow batches in parts of bounded size, so that a Python worker's memory does not grow with its batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or items of lists, that are Python objects at once; one row's at least.
PART, ITEMS = 1 << 20, 1 << 16


def ends(column: pa.Array) -> list[int]:
    """Where the parts of a column of texts or lists end: each has PART bytes or ITEMS items at most, or is one row."""
    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes, most = (pc.list_value_length(column), ITEMS) if lists else (pc.binary_length(column), PART)
    upto = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, done = [], 0
    while (start := out[-1] if out else 0) < len(upto):
        out.append(max(start + 1, int(np.searchsorted(upto, done + most, "right"))))
        done = int(upto[out[-1] - 1])
    return out


def parts(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut by the sizes of a column."""
    for batch in batches:
        start = 0
        for end in ends(batch.column(column)):
            yield batch.slice(start, end - start)
            start = end
