"""Quality classifier: ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, hashes, mix, runs, slices, text_bytes
from .common import carried, named, schema_of

#: Letters, digits and every byte above ASCII.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_KINDS = {"upper": range(65, 91), "digit": range(48, 58), "mark": b"!?.,;:'\"()-", "symbol": b"#*$%&|<>=+/\\@^~_{}[]`", "line": b"\n", "wide": range(128, 256)}


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Documents and 64-bit features of a text column, each pair once, in the order of documents.

    Features are the lower-cased words and, in twenty steps each, shares of byte classes and of distinct words and the
    length, which tell shouting, tables and repetition from prose.
    """
    raw, off = text_bytes(column)
    data, n = LOWER[raw], len(column)
    starts, ends, doc = runs(data, off, _WORD)
    h = hashes(data, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    words = np.bincount(doc, minlength=n)
    h, doc = h[first], doc[first]
    size = np.maximum(np.diff(off), 1)
    shares = []
    for members in _KINDS.values():
        flag = np.zeros(256, np.int64)
        flag[list(members)] = 1
        sums = np.append(0, np.cumsum(flag[raw]))
        shares.append((sums[off[1:]] - sums[off[:-1]]) / size)
    shares.append(np.bincount(doc, minlength=n) / np.maximum(words, 1))
    steps = [np.minimum((20 * np.sqrt(s)).astype(np.int64), 19) for s in shares] + [np.log2(size).astype(np.int64)]
    extra = [mix((1000 * k + s).astype(np.uint64) + np.uint64(0xA5A5A5A500000000)) for k, s in enumerate(steps)]
    doc, h = np.concatenate([doc] + [np.arange(n)] * len(extra)), np.concatenate([h, *extra])
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted features with one weight each, shared by all grades, and ordered thresholds: P(grade >= k) = s(score - t_k)."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.bincount(doc[hit], self.weights[at[hit]], n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(doc: np.ndarray, keys: np.ndarray, grade: np.ndarray, grades: int, min_docs: int = 8, epochs: int = 50, rate: float = 0.3, l1: float = 3e-4, batch: int = 128) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by AdaGrad over small batches; features of few documents are left out.

    The L1 step keeps words that say nothing at zero, so the score of a long text is not the sum of much noise.
    """
    names, column, seen = np.unique(keys, return_inverse=True, return_counts=True)
    ok = seen >= min(min_docs, max(2, len(grade) // 20))
    used = ok[column]
    doc, column = doc[used], (np.cumsum(ok) - 1)[column[used]]
    names = names[ok]
    w, t = np.zeros(len(names)), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    gw, gt = np.full(len(names), 1e-2), np.full(grades - 1, 1e-2)
    ptr = np.append(np.searchsorted(doc, np.arange(len(grade))), len(doc))
    rng = np.random.default_rng(0)
    for epoch in range(epochs):
        order = rng.permutation(len(grade))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            lens = ptr[rows + 1] - ptr[rows]
            cols = column[np.repeat(ptr[rows] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())]
            local = np.repeat(np.arange(len(rows)), lens)
            s, y = np.bincount(local, w[cols], len(rows)), grade[rows]
            edges = np.concatenate([[-np.inf], t, [np.inf]])
            a, b = (1 / (1 + np.exp(np.clip(edges[k] - s, -500, 500))) for k in (y, y + 1))
            p = np.maximum(a - b, 1e-9)
            up = (1 - a - b) / len(rows)  # slope of the log-likelihood in the score
            g = np.bincount(cols, up[local], len(w))
            touched = np.unique(cols)
            gw[touched] += g[touched] ** 2
            step = rate / np.sqrt(gw[touched])
            moved = w[touched] + step * g[touched]
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            dt = np.zeros(grades + 1)
            np.add.at(dt, y, -a * (1 - a) / p / len(rows))
            np.add.at(dt, y + 1, b * (1 - b) / p / len(rows))
            gt += dt[1:-1] ** 2
            t = np.maximum.accumulate(t + rate * dt[1:-1] / np.sqrt(gt))
    return OrdinalModel(names, w, t)


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> OrdinalModel:
    """Fits on at most ``sample`` rated documents; ``ratings`` has ``id_col`` and ``grade`` (0 .. grades - 1).

    The sample is the documents whose id hashes lowest, so it does not depend on the order of rows; repeated ratings
    of a document count by their smallest grade, null grades and ids not at all. Its ids (at most ``sample`` small
    rows) are broadcast, features are made where the texts lie, and one task fits the bounded sample. Without a rated
    document the model is empty: every score is 0.
    """
    chosen = ratings.filter(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("grade").cast("long").alias("_grade"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rated = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            doc, keys = features(b.column(text_col))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            rows = [keys[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.string()), b.column("_grade"), pa.array(rows, pa.binary())], ["id", "grade", "keys"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))})
        if rows:
            keys = [np.frombuffer(r[2], np.uint64) for r in rows]
            doc = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
            m = fit(doc, np.concatenate(keys), np.array([r[1] for r in rows]), grades)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.keys, m.weights, m.thresholds)], ["keys", "weights", "thresholds"])

    found = rated.mapInArrow(extract, "id string, grade long, keys binary").repartition(1).mapInArrow(learn, "keys binary, weights binary, thresholds binary").collect()
    if not found:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.zeros(grades - 1))
    return OrdinalModel(np.frombuffer(found[0][0], np.uint64), np.frombuffer(found[0][1]), np.frombuffer(found[0][2]))


def classify(docs: DataFrame, model: OrdinalModel, at_least: int, tail: float = 0.5, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of every row (all by default) with score, expected_grade, tail_probability and ``kept``.

    ``tail_probability`` is P(grade >= at_least); a document is kept from ``tail`` on. One pass, no shuffle; the model
    (its size is bounded by the sample it was fitted on) travels as a broadcast variable. Null text counts as empty and
    is judged by the thresholds and its length alone. Of a carried column named like a new one, the new one stays. No rows
    give no rows.
    """
    new = ["score", "expected_grade", "tail_probability", "kept"]
    keep = carried(docs.columns if carry is None else carry, new)
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.thresholds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*shared.value)
        for b in slices(batches, text_col):
            s = m.score(*features(b.column(text_col)), b.num_rows)
            p = m.tails(s)
            top = p[:, at_least - 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(s), pa.array(p.sum(1)), pa.array(top), pa.array(top >= tail)], [*keep, *new],
            )

    kind = schema_of(docs, keep, "score double, expected_grade double, tail_probability double, kept boolean")
    return docs.select(*named(list(dict.fromkeys([*keep, text_col])))).mapInArrow(judge, kind)


def ratings_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from the labels: 0 toxic, 1 harmless but poor, 2 sound and clean; a missing label gives no grade.

    Toxic is the lowest grade: there a word may lower the score without a limit, while a middle grade would bound it.
    """
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(id_col, grade.alias("grade"))
