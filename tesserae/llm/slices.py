"""Arrow batches walked in slices of bounded size."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice, more only where a single text has more.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, as views that hold about ``SLICE_BYTES`` of the column ``text``.

    What is made of a slice can go before the next one comes, so a worker holds a batch and
    little beside it.  An empty batch is one slice.  In the end Arrow gives back what it keeps, since
    Spark's workers wait for other tasks.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
        for low, high in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(low, high - low)
        del batch
    pa.default_memory_pool().release_unused()
