"""Nearest neighbours from several shifted Hilbert orders of projected vectors.

Equal vectors are first joined into one class, so that copies cost nothing and ties are exact. Each order projects the
classes on a few directions of its own, shifts them and sorts them along a Hilbert curve by ranges in Spark; a query
looks at all classes within a window of positions on both sides of its own. The window is not a constant: it is the
one that holds nearly all true neighbours of a bounded sample of queries in at least one order, so it is narrow where
the vectors have structure and wide where they have none. Windows compare 8-bit codes; the best of all windows of a
query are merged and measured again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import finite, fold, matrices

AXES, BITS = 6, 10
BLOCK = 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of unsigned coordinates below 2**bits) along the Hilbert curve: axes are turned back level
    by level, Gray-coded, and their bits interleaved."""
    x = cells.T.astype(np.int64)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> level & 1
    return key


@dataclass
class Curves:
    """Directions, shifts and quantiles of each order; the mean that codes are taken from."""

    mean: np.ndarray
    directions: list[np.ndarray]
    shifts: list[np.ndarray]
    cuts: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, orders: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        mean = sample.mean(0)
        e, u = np.linalg.eigh(np.atleast_2d(np.cov(sample.T, bias=True)))
        root = u * np.sqrt(np.maximum(e, e.max(initial=0) * 1e-9 + 1e-300))  # wide directions are drawn more often
        axes = min(AXES, sample.shape[1])
        directions = [np.linalg.qr(root @ rng.standard_normal((len(mean), axes)))[0] for _ in range(orders)]
        shifts = [rng.random(axes) for _ in range(orders)]
        cuts = [np.quantile((sample - mean) @ w, np.linspace(0, 1, 129), axis=0) for w in directions]
        return Curves(mean, directions, shifts, cuts)

    def keys(self, m: np.ndarray) -> np.ndarray:
        """One column of keys an order: ranks among the sample's quantiles, shifted, on a grid."""
        out = []
        for w, shift, cuts in zip(self.directions, self.shifts, self.cuts):
            p = (m - self.mean) @ w
            rank = np.stack([np.interp(p[:, i], cuts[:, i], np.linspace(0, 1, len(cuts))) for i in range(p.shape[1])], axis=1)
            out.append(hilbert_keys(np.minimum(((rank + shift) / 2 * 2**BITS).astype(np.int64), 2**BITS - 1), BITS))
        return np.stack(out, axis=1)

    def codes(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bits an entry, with a scale for each vector."""
        y = m - self.mean
        scale = np.abs(y).max(1, initial=0) / 127
        return scale, np.rint(y / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)


def _classes(df: DataFrame, vector: str, id_col: str, is_query: Column, k: int) -> DataFrame:
    """(cid, ids, query, vec): each distinct vector once, with its k + 1 smallest ids and whether a query has it."""
    by = Window.partitionBy("vec").orderBy("id")
    few = df.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k + 1)
    queried = df.filter("query").select("vec", "query").distinct()
    rows = few.select("vec", "id", F.lit(False).alias("query")).unionByName(queried.select("vec", F.lit(None).cast("long").alias("id"), "query"))
    out = rows.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("query").alias("query"))
    return written(out.select(F.monotonically_increasing_id().alias("cid"), "ids", "query", "vec"), "vector-classes")


def _doubles(column: pa.Array) -> np.ndarray:
    return next((m.astype(float) for _, _, m in matrices(column)), np.zeros((0, 0)))


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b, by one matrix product."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _best(d: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    if d.shape[1] > m:
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        return np.take_along_axis(d, at, 1), np.take_along_axis(ids, at, 1)
    return d, ids


def _true_neighbours(classes: DataFrame, cids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Exact neighbours of the sampled classes among all classes (-1: fewer than k)."""

    def add(state, batch):
        m, ids = _doubles(batch.column(1)), batch.column(0).to_numpy()
        d = _nearest(vectors, m)
        d[cids[:, None] == ids[None, :]] = np.inf
        found = _best(d, np.broadcast_to(ids, d.shape), k)
        return found if state is None else merge(state, found)

    def merge(a, b):
        return _best(np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]]), k)

    d, ids = fold(classes.select("cid", "vec"), add, merge)
    return np.where(np.isfinite(d), ids, -1)


def _positions(keyed: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each row in its order, from the sizes of the ranges (one row a range)."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            orders = b.column(0).to_numpy()
            row = np.empty(len(orders), np.int64)
            for o in np.unique(orders).tolist():
                at = np.flatnonzero(orders == o)
                row[at] = seen.get(o, 0) + np.arange(len(at))
                seen[o] = seen.get(o, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(orders), part, np.int32)), pa.array(row)], [*b.schema.names, "_part", "_row"])

    ranged = keyed.repartitionByRange("order", "key", "cid").sortWithinPartitions("order", "key", "cid")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    rows = written(ranged.mapInArrow(numbered, f"{schema}, _part int, _row long"), "hilbert-orders")
    sizes = rows.groupBy("order", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("order").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("order", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return rows.join(offsets, ["order", "_part"]).select(*keyed.columns, (F.col("_off") + F.col("_row")).alias("pos"))


def _windows(batches: Iterator[pa.RecordBatch], window: int, d: int, m: int) -> Iterator[pa.RecordBatch]:
    """Rows come by order and block, the block's classes before the queries that reach into it: a block is held (it has
    at most BLOCK rows), the queries stream past."""
    here, held, block = None, [], None

    def decoded(b: pa.RecordBatch) -> np.ndarray:
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, d)
        return code.astype(np.float32) * b.column("scale").to_numpy().astype(np.float32)[:, None]

    for batch in batches:
        order, blocks, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("order", "block", "tag"))
        edges = np.flatnonzero(np.diff(order) | np.diff(blocks) | np.diff(tag)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(order)]):
            part = batch.slice(start, end - start)
            if (order[start], blocks[start]) != here:
                here, held, block = (order[start], blocks[start]), [], None
            if tag[start] == 0:
                held.append((part.column("cid").to_numpy(), part.column("pos").to_numpy(), decoded(part)))
                continue
            if block is None and held:
                block = [np.concatenate(x) for x in zip(*held)]
            if block is None:
                continue
            ids, pos, vectors = block
            for i in range(0, part.num_rows, 512):
                q = part.slice(i, 512)
                qid = q.column("cid").to_numpy()
                dist = _nearest(decoded(q), vectors).astype(float)
                dist[np.abs(q.column("pos").to_numpy()[:, None] - pos[None, :]) > window] = np.inf
                dist[qid[:, None] == ids[None, :]] = np.inf
                dist, near = _best(dist, np.broadcast_to(ids, dist.shape), m)
                found = [np.flatnonzero(np.isfinite(r)) for r in dist]
                yield pa.RecordBatch.from_arrays([
                    pa.array(qid), pa.array([n[f] for n, f in zip(near, found)], pa.list_(pa.int64())), pa.array([n[f] for n, f in zip(dist, found)], pa.list_(pa.float64())),
                ], ["qid", "cids", "dists"])


def nearest_neighbours(
    df: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", id_col: str = "vec_id",
    orders: int = 3, target: float = 0.97, sample: int = 4096, probes: int = 128, seed: int = 13,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``k`` nearest rows found for each query row, by Euclidean distance.

    Directions and quantiles are fitted on the ``sample`` classes with the smallest hashes; the window is the smallest
    that holds the share ``target`` of the true neighbours of ``probes`` query classes (smallest hashes; compared with
    all classes) in one of the ``orders``. All classes are indexed and can be found.

    Vectors that are null, zero, hold null or non-finite entries, or have another length than most, and rows without an
    id take no part. Rows repeating an id and vector are neighbours of one another. Ties go to smaller ids. With fewer
    than ``k`` other rows all are returned; an empty table or one without queries gives no rows. Other columns are
    neither read nor returned.
    """
    usable = df.filter(finite(vector) & F.exists(vector, lambda e: e != 0) & F.col(id_col).isNotNull())
    most = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    none = df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if most is None:
        return none
    d, n_rows = most["d"], most["count"]
    rows = usable.filter(F.size(vector) == d).select(F.col(vector).alias("vec"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"))
    classes = _classes(rows, vector, id_col, is_query, k)

    fitted = _doubles(pa.array(classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vec").toPandas()["vec"], pa.list_(pa.float64())))
    probe = classes.filter("query").orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(probes).select("cid", "vec").toPandas()
    if not len(probe):
        return none
    curves = Curves.fit(fitted, orders, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _doubles(b.column(2))
            if len(m):
                keys, (scale, code) = curves.keys(m), curves.codes(m)
                for o in range(orders):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(m), o, np.int32)), pa.array(keys[:, o]), b.column(0), b.column(1), pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary()),
                    ], ["order", "key", "cid", "query", "scale", "code"])

    keyed = classes.select("cid", "query", "vec").mapInArrow(coded, "order int, key long, cid long, query boolean, scale double, code binary")
    placed = _positions(keyed)

    cids = probe["cid"].to_numpy()
    true = _true_neighbours(classes, cids, np.stack(probe["vec"]).astype(float), k)
    wanted = sorted({*cids.tolist(), *true.ravel().tolist()} - {-1})  # at most probes * (k + 1)
    asked = df.sparkSession.createDataFrame([(c,) for c in wanted], "cid long")
    at = {(r["order"], r["cid"]): r["pos"] for r in placed.join(F.broadcast(asked), "cid").select("order", "cid", "pos").collect()}
    reach = sorted(min(abs(at[o, q] - at[o, c]) for o in range(orders)) for q, near in zip(cids.tolist(), true.tolist()) for c in near if c >= 0)
    window = max(4 * k, reach[min(len(reach) - 1, int(np.ceil(target * len(reach))))] if reach else 0)

    block = F.floor(F.col("pos") / BLOCK)
    data = placed.select("order", block.alias("block"), F.lit(0).alias("tag"), "pos", "cid", "scale", "code")
    reached = F.sequence(F.greatest(F.floor((F.col("pos") - window) / BLOCK), F.lit(0)), F.least(F.floor((F.col("pos") + window) / BLOCK), F.lit((n_rows - 1) // BLOCK)))
    asking = placed.filter("query").select("order", F.explode(reached).alias("block"), F.lit(1).alias("tag"), "pos", "cid", "scale", "code")
    m = 4 * k
    met = data.union(asking).repartition("order", "block").sortWithinPartitions("order", "block", "tag")
    found = met.mapInArrow(lambda it: _windows(it, window, d, m), "qid long, cids array<long>, dists array<double>")
    found = found.select("qid", F.explode(F.arrays_zip("cids", "dists")).alias("c")).select("qid", F.col("c.cids").alias("cid"), F.col("c.dists").alias("dist"))
    found = found.groupBy("qid", "cid").agg(F.min("dist").alias("dist"))
    short = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "cid"))).filter(F.col("_n") <= m).select("qid", "cid")
    short = short.union(classes.filter("query").select(F.col("cid").alias("qid"), "cid"))

    theirs = classes.select("cid", "ids", F.col("vec").cast("array<double>").alias("b"))
    own = classes.filter("query").select(F.col("cid").alias("qid"), F.col("vec").cast("array<double>").alias("a"))
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = short.join(theirs, "cid").join(own, "qid").select("qid", F.sqrt(square).alias("score"), F.explode("ids").alias("id"))
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))).filter(F.col("_n") <= k + 1)
    lists = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))

    # Every query row takes its class's list without one entry of its own.
    asked_by = rows.filter("query").select("id", "vec").join(classes.select("cid", "vec"), "vec").select(F.col("id").alias("query_id"), F.col("cid").alias("qid"))
    answered = asked_by.join(lists, "qid")
    own_at = F.array_position(F.transform("near", lambda x: x["id"]), F.col("query_id"))
    near = F.when(own_at > 0, F.filter("near", lambda x, i: i != own_at - 1)).otherwise(F.col("near"))
    out = answered.select("query_id", F.posexplode(F.slice(near, 1, k)).alias("rank", "c"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("c.id").alias(id_col), F.col("c.score").alias("score"))
