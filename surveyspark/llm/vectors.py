"""Vector columns as matrices, and sums over a whole table folded in a few steps."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str, limit: float = float("inf")) -> Column:
    """True where the vector is there and each of its entries is a number of less than ``limit`` in size."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < limit))


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, matrix) for each length among the vectors of a batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, values[(ends[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def fold(df: DataFrame, add: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any], fan: int = 16) -> Any:
    """One state for all rows: a task folds its batches into one, ``fan`` tasks merge those, a last one merges theirs.

    ``add(None, batch)`` starts a state. What reaches the driver is one state; None for a table without rows.
    """

    def partial(batches):
        state = None
        for b in batches:
            if b.num_rows:
                state = add(state, b)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def merged(batches):
        state = None
        for b in batches:
            for s in b.column(0):
                s = pickle.loads(s.as_py())
                state = s if state is None else merge(state, s)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    states = df.mapInArrow(partial, "state binary").repartition(fan).mapInArrow(merged, "state binary")
    row = states.repartition(1).mapInArrow(merged, "state binary").first()
    return None if row is None else pickle.loads(row["state"])
