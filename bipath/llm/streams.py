"""Helpers for tasks that go through sorted Arrow batches in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def routed(df: DataFrame, route: str, *order: str) -> DataFrame:
    """Rows of one ``route`` in one partition, in order."""
    return df.repartition(route).sortWithinPartitions(route, *order)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str, null: int = -(1 << 63)) -> np.ndarray:
    return column(batch, name).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint64)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) if not isinstance(v, pa.Array) else v for k, v in columns.items()})


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def run_starts(new: np.ndarray) -> np.ndarray:
    """For each row the index of the first row of its run."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def whole_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Hands rows sorted by ``keys`` on to ``work`` so that no group is cut.

    What is held is one Arrow batch and the group at its end, so groups must be bounded.
    """
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        new = changes(*(held.column(k).to_numpy() for k in keys))
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield from work(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield from work(held)
