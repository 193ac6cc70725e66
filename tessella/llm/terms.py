"""Words of whole batches as Arrow arrays, and their counts summed up before they leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessella.llm import kernels as K

#: Rows that a task sums up before it hands on what it has counted.
HELD_ROWS = 300_000


def term_array(buf: np.ndarray, inside: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of True of every document as strings, and the document of each."""
    starts, ends, count = K.spans(inside, off)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    data = np.ascontiguousarray(buf[inside])
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data))
    return text, np.repeat(np.arange(len(count)), count)


def pair_counts(left: np.ndarray, right: np.ndarray, width: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left, right < width) with their numbers, or the sums of their weights."""
    key = left * np.int64(width) + right
    if weights is None:
        pairs, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        pairs, n = key[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]
    return pairs // width, pairs % width, n


def summed(tables: Iterator[pa.Table], keys: list[str], sums: list[str], rows: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """The sums by key of a task's tables.

    A key comes out once, or a few times if a task has more than ``rows`` distinct ones:
    what is held is bounded, and the aggregation that follows adds up the rest.
    """
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        out = pa.concat_tables(held).group_by(keys).aggregate([(c, "sum") for c in sums])
        return out.select([*keys, *(f"{c}_sum" for c in sums)]).rename_columns([*keys, *sums])

    for table in tables:
        held.append(table)
        if sum(t.num_rows for t in held) > rows:
            held = [merged()]
            if held[0].num_rows > rows // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held = []
    if held:
        yield from merged().to_batches(max_chunksize=50_000)
