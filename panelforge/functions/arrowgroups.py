"""Walk sorted partitions group by group, in Arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def numbers(table: pa.Table, column: str, missing: float = np.nan) -> np.ndarray:
    """A float64 array of ``column``; nulls become ``missing``."""
    values = table.column(column).combine_chunks()
    out = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    if missing == missing and values.null_count:
        out = np.where(np.isnan(out), missing, out)
    return out


def integers(table: pa.Table, column: str, missing: int = -1) -> np.ndarray:
    """An int64 array of ``column`` (dates as days); nulls become ``missing``."""
    values = table.column(column).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    if pa.types.is_date32(values.type):
        values = values.cast(pa.int32())
    values = values.cast(pa.int64())
    if values.null_count:
        values = values.fill_null(missing)
    return values.to_numpy(zero_copy_only=False)


def starts(*keys: np.ndarray) -> np.ndarray:
    """The positions at which a new group begins, then the length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    fresh = np.zeros(n, dtype=bool)
    fresh[0] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.r_[np.flatnonzero(fresh), n]


def complete_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 65536) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never split a group of adjacent equal ``keys``."""
    held: list[pa.RecordBatch] = []
    count, limit = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < limit:
            continue
        whole = pa.Table.from_batches(held)
        cut = int(starts(*(integers(whole, k) for k in keys))[-2])
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
            held, count, limit = rest.to_batches(), rest.num_rows, rows
        else:
            limit *= 2
    if held:
        yield pa.Table.from_batches(held)
