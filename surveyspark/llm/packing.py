"""Best-fit-decreasing packing of token sequences into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import schema_of, written
from .tokens import encoded

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Segment tree over remaining capacities 0..size: finds the tightest open window that still takes a piece."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = np.zeros(2 * self.width, np.int64).tolist()
        self.windows: list[list[int]] = [[] for _ in range(self.width)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.windows[capacity].pop()

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` at which a window is open."""
        i = need + self.width
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the right sibling holds larger capacities
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, longest first; none exceeds ``window``."""
    where, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = free.tightest(n) if n < window else None
        if capacity is None:
            w, capacity, opened = opened, window, opened + 1
        else:
            w = free.take(capacity)
        where[i], at[i] = w, window - capacity
        if capacity > n:
            free.put(capacity - n, w)
    return where, at


def _pieces(batches: Iterator[pa.RecordBatch], text: str, name: str, end_id: int, window: int, keep: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Full windows of each document and its rest."""
    end = np.array([end_id], "<u4").tobytes()
    for b, found in encoded(batches, text, name):
        rows, cols, pieces = [], ([], [], [], []), []
        for i, ids in enumerate(found):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start:4 * (start + window)]
                rows.append(i)
                for c, v in zip(cols, (start, len(piece) // 4, zlib.crc32(piece), n)):
                    c.append(v)
                if with_ids:
                    pieces.append(piece)
        out = [b.column(c).take(pa.array(rows, pa.int64())) for c in keep] + [pa.array(c, pa.int64()) for c in cols]
        names = [*keep, "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays(out + [pa.array(pieces, pa.binary())] * with_ids, names + ["ids"] * with_ids)


def pack(docs: DataFrame, window: int = 2048, name: str = "word_bpe_49k.json", end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", shard_pieces: int = 50_000, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document (its ids, then ``end_id``) is cut into full windows and a rest. Rests are dealt evenly by hash into
    shards of about ``shard_pieces`` and packed best-fit decreasing inside each: the segment tree over remaining
    capacities finds the tightest open window, which needs a few steps a piece and memory in proportion to the shard.
    A full window is a sequence of its own and never enters a shard. Shards are many at any size of input, no document is hot (a long one is just
    more full windows), and the token pass writes its small rows to the shared folder once, so neither the count nor
    a lost executor encodes twice. ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit binary.

    ``sequence_id`` is unique, not dense: full windows are negative, the rests' sequences are shard * 2^32 + window.
    Sequences are at most ``window`` long; the rest of one is padding (none at a power of two, where a batch needs none).
    Null text is empty and gives one piece, the end id. Repeated rows are packed each. No rows give no rows.
    """
    kind = schema_of(docs, [id_col], PIECE + (", ids binary" if with_ids else ""))
    pieces = docs.select(id_col, text_col).mapInArrow(lambda it: _pieces(it, text_col, name, end_id, window, [id_col], with_ids), kind)
    pieces = written(pieces, "pieces")
    rests = pieces.filter(F.col("length") < window)
    shards = -(-rests.count() // shard_pieces) or 1
    names = pieces.columns

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        where, at = best_fit(pdf["length"].to_numpy(), window)
        pdf["sequence_id"], pdf["offset"] = (pdf["_shard"].to_numpy() << 32) + where, at
        return pdf.drop(columns="_shard")

    out = T.StructType(list(pieces.schema.fields) + T._parse_datatype_string("struct<sequence_id: bigint, offset: bigint>").fields)
    dealt = rests.withColumn("_shard", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(shards)))
    full = pieces.filter(F.col("length") == window).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("_shard").applyInPandas(packed, out).union(full)
