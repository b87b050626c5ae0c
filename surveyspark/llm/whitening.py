"""Whitening of an embedding table: exact integer moments on Spark, leading eigenpairs by spectrum slicing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import schema_of, written
from .spectrum import leading
from .vectors import finite, fold, matrices

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0**46  # entries beyond have no 64-bit integer form with room for sums

MORE = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What the fit leaves: n vectors with sums S, components as columns with their eigenvalues, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in integers that cannot overflow."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + 1) >= 2**61
        x = x.astype(object) if wide else x
        return self.n * x - np.array(self.sums, object if wide else np.int64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ (self.components / np.sqrt(self.values))

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares as exact integers; None where one has no 64-bit form."""
        if int(np.abs(centred).max(initial=0)) ** 2 * max(1, centred.shape[1]) < 2**63:
            return (centred.astype(np.int64) ** 2).sum(1).tolist()
        return [x if x < 2**63 else None for x in (int((r * r).sum()) for r in centred.astype(object))]


def quantised(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m.astype(float)).astype(np.int64) + OFFSET


def _exact_gram(z: np.ndarray) -> np.ndarray:
    """Sums of products as Python integers; floats serve where none of the sums can leave their exact range."""
    out = np.zeros((z.shape[1],) * 2, object)
    top = int(np.abs(z).max(initial=0))
    rows = 2**53 // max(1, top * top)
    if rows < 1:
        z = z.astype(object)
        return out + z.T @ z
    for i in range(0, len(z), min(rows, 8192)):
        part = z[i:i + min(rows, 8192)].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _totals(state, batch: pa.RecordBatch):
    """By length of the vectors: how many, and their sums."""
    state = state or {}
    for d, _, x in matrices(batch.column(0)):
        n, s = state.get(d, (0, np.zeros(d, object)))
        state[d] = (n + len(x), s + x.sum(0, dtype=np.int64).astype(object))  # a batch is short and x below 2**53
    return state


def _merge_totals(a, b):
    return {d: tuple(x + y for x, y in zip(a[d], b[d])) if d in a and d in b else a.get(d) or b[d] for d in {*a, *b}}


def _products(d: int, middle: list[int]):
    def add(state, batch):
        for size, _, x in matrices(batch.column(0)):
            if size == d:
                m = _exact_gram(x - np.array(middle, np.int64))
                state = m if state is None else state + m
        return state

    return add


def _spread(model: Whitening):
    """Sums and products of the whitened vectors."""

    def add(state, batch):
        for size, _, x in matrices(batch.column(0)):
            if size == len(model.sums):
                w = model.project(model.centred(x))
                found = (w.sum(0), w.T @ w)
                state = found if state is None else tuple(a + b for a, b in zip(state, found))
        return state

    return add


def fit(df: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Fits on each distinct quantised vector once; None if no vector is usable.

    Three passes over the distinct vectors: counts and sums; products, centred on the whole number next to the mean
    and summed in exact integers; the spread of the result. Only sums as wide as a vector reach the driver. The length
    fitted is the one most distinct vectors have (of equally frequent ones the largest).
    """
    x = F.transform(F.col(vector).cast("array<double>"), lambda e: F.floor(e * SCALE) + OFFSET)
    fit_list = written(df.filter(finite(vector, LIMIT)).select(x.alias("x")).distinct(), "fit-list")
    totals = fold(fit_list, _totals, _merge_totals) or {}
    totals.pop(0, None)
    if not totals:
        return None
    d = max(totals, key=lambda k: (totals[k][0], k))
    n, sums = totals[d][0], [int(s) for s in totals[d][1]]
    middle = [s // n for s in sums]
    products = fold(fit_list, _products(d, middle), lambda a, b: a + b)
    rest = [s - n * m for s, m in zip(sums, middle)]  # what is left to the exact mean
    # Integer over integer division rounds once: the covariance is right to the last bit.
    v = np.array([[(n * int(products[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = leading(v, components)
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    if len(values):
        total, gram = fold(fit_list, _spread(model), lambda a, b: tuple(p + q for p, q in zip(a, b)))
        mean = total / n
        model.identity_error = float(np.abs(gram / n - np.outer(mean, mean) - np.eye(len(values))).max())
    return model


def whiten(df: DataFrame, vector: str = "embedding", components: int = 16, carry: list[str] | None = None) -> DataFrame:
    """One row for each usable vector and component: ``carry`` columns (all but the vector by default), then
    component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold null, NaN, infinite or larger entries than 2**46, or have another length than the
    fitted one are dropped. Repeated rows each give their rows, but count once in the fit. A null id is carried like
    any other value. Components without variance do not exist: a constant table gives no rows, and neither does an
    empty one. ``deviation`` is null where the exact sum has no 64-bit form. Of a carried column named like one of the
    new ones, the new one stays.
    """
    new = [f.name for f in T._parse_datatype_string(f"struct<{MORE}>")]
    carry = [c for c in ([c for c in df.columns if c != vector] if carry is None else carry) if c not in new]
    schema = schema_of(df, carry, MORE)
    model = fit(df, vector, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    d, k = len(model.sums), len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, at, m in matrices(b.column(b.num_columns - 1)):
                for i in range(0, len(at) if size == d else 0, 4096):
                    centred = model.centred(quantised(m[i:i + 4096]))
                    rows = len(centred)
                    index = pa.array(np.repeat(at[i:i + 4096], k))
                    yield pa.RecordBatch.from_arrays([
                        *(b.column(c).take(index) for c in range(len(carry))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        pa.array(model.deviations(centred), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(model.project(centred).ravel()),
                        pa.array(np.tile(model.values / model.trace, rows)),
                        pa.array(np.full(rows * k, model.identity_error)),
                    ], [*carry, *new])

    usable = df.filter(finite(vector, LIMIT)).select(*carry, F.col(vector).cast("array<double>").alias("_vector"))
    return usable.mapInArrow(apply, schema)
