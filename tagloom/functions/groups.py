"""Groups of key-sorted partitions as a stream, so that no group is collected before its turn and memory stays bounded by the largest group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal values in the first ``keys`` columns; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for i in range(keys):
            codes = b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], n)
        for s, e in zip(starts.tolist(), ends.tolist()):
            key = tuple(b.column(i)[s].as_py() for i in range(keys))
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(b.slice(s, e - s))
    if current is not None:
        yield current, pa.Table.from_batches(held)
