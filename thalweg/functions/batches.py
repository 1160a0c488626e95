"""Arrow batches cut so that what Python makes of one stays small, however many rivers a batch holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values in the longest list column of a slice; a longer row is a slice of its own.
MOST_VALUES = 50_000


def slices(batches: Iterable[pa.RecordBatch], most: int = MOST_VALUES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most ``most`` values in any list column, or of one row."""
    for batch in batches:
        size = np.ones(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                size = np.maximum(size, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        before, low = np.concatenate([[0], np.cumsum(size)]), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(before, before[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
