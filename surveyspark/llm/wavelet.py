"""Token-id files: one wavelet matrix per shard of documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoded

#: part and seq order the shards; the body is a whole file, see WaveletMatrix.to_bytes.
SHARD = "part long, seq long, n_docs long, n_tokens long, body binary"
_HEAD = "<4sIQQ"


class WaveletMatrix:
    """Bit-planes of a token sequence, the highest bit first; in each plane tokens with a 0 go before those with a 1.

    Access, rank (occurrences before a position), count and select (place of the k-th occurrence) take one step for
    each plane and work on whole arrays of positions.
    """

    def __init__(self, planes: list[np.ndarray], n: int, doc_ids: np.ndarray, starts: np.ndarray):
        self.planes, self.n, self.doc_ids, self.starts = planes, n, doc_ids, starts
        self._words: list[tuple[np.ndarray, np.ndarray]] | None = None
        self.zeros = [n - int(np.bitwise_count(p).sum()) for p in planes]

    @classmethod
    def build(cls, tokens: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> WaveletMatrix:
        n, bits = len(tokens), int(tokens.max()).bit_length() if len(tokens) else 0
        row = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            one = (row & row.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            row = np.concatenate([np.compress(~one, row), np.compress(one, row)])
        return cls(planes, n, np.asarray(doc_ids, np.int64), np.asarray(starts, np.int64))

    def to_bytes(self) -> bytes:
        """Head, document ids and starts, then the planes, each a length and a zstandard frame."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [struct.pack(_HEAD, b"WVM1", len(self.planes), self.n, len(self.doc_ids))]
        for a in (self.doc_ids, self.starts, *self.planes):
            frame = squeeze(a.tobytes())
            parts += [struct.pack("<Q", len(frame)), frame]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, body: bytes) -> WaveletMatrix:
        import zstandard

        magic, planes, n, docs = struct.unpack_from(_HEAD, body)
        if magic != b"WVM1":
            raise ValueError("no wavelet matrix file")
        at, arrays, expand = struct.calcsize(_HEAD), [], zstandard.ZstdDecompressor().decompress
        for i in range(planes + 2):
            (size,) = struct.unpack_from("<Q", body, at)
            raw = expand(body[at + 8:at + 8 + size])
            arrays.append(np.frombuffer(raw, np.int64 if i < 2 else np.uint8))
            at += 8 + size
        return cls(arrays[2:], n, arrays[0], arrays[1])

    def _support(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each plane as 64-bit words and the ones before each word."""
        if self._words is None:
            self._words = []
            for p in self.planes:
                w = np.zeros(self.n // 64 + 1, np.uint64)
                w.view(np.uint8)[:len(p)] = p
                before = np.zeros(len(w) + 1, np.int64)
                np.cumsum(np.bitwise_count(w), out=before[1:])
                self._words.append((w, before))
        return self._words

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        w, before = self._support()[plane]
        part = w[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(part)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at some positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for k in range(len(self.planes)):
            w = self._support()[k][0]
            one = (w[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(k, at)
            out = (out << np.uint32(1)) | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, at: np.ndarray) -> tuple[np.ndarray, int]:
        """Where the tokens before each position that share the token's bits end in the last row, and where they start."""
        at, start = np.append(np.asarray(at, np.int64), 0), 0
        for k in range(len(self.planes)):
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if token >> (len(self.planes) - 1 - k) & 1 else at - ones
        return at[:-1], int(at[-1])

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of the token before each position."""
        if token >> len(self.planes):
            return np.zeros(len(np.atleast_1d(at)), np.int64)
        end, start = self._range(token, np.atleast_1d(at))
        return end - start

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        lo, hi = self.rank(token, np.array([start, self.n if end is None else end]))
        return int(hi - lo)

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th occurrences, from 0; each k must be below ``count(token)``."""
        at = np.asarray(k, np.int64) + self._range(token, np.zeros(0, np.int64))[1]
        for p in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[p], count=self.n, bitorder="little")
            if token >> (len(self.planes) - 1 - p) & 1:
                at = np.flatnonzero(bits)[at - self.zeros[p]]
            else:
                at = np.flatnonzero(bits == 0)[at]
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, rebuilt from the last row upwards."""
        if not self.planes:
            return np.zeros(self.n, np.uint32)
        row = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[k], np.empty_like(row)
            up[np.flatnonzero(~one)] = row[:z]  # places, not masks: several times faster on random bits
            up[np.flatnonzero(one)] = row[z:] | row.dtype.type(1 << (len(self.planes) - 1 - k))
            row = up
        return row.astype(np.uint32)

    def document(self, doc_id: int) -> np.ndarray:
        """Tokens of one document of the file."""
        i = int(np.searchsorted(self.doc_ids, doc_id))
        if i == len(self.doc_ids) or self.doc_ids[i] != doc_id:
            raise KeyError(doc_id)
        end = self.starts[i + 1] if i + 1 < len(self.starts) else self.n
        return self.access(np.arange(self.starts[i], end))


def _shards(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, name: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    ids, docs, held = [], [], 0

    def flush() -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum([0] + [len(x) // 4 for x in ids[:-1]])
        body = WaveletMatrix.build(tokens, docs, starts).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int64()), (seq, pa.int64()), (len(docs), pa.int64()), (len(tokens), pa.int64()), (body, pa.binary()))], ["part", "seq", "n_docs", "n_tokens", "body"])

    for b, found in encoded(batches, text_col, name):
        for doc, x in zip(b.column(id_col).to_pylist(), found):
            ids.append(x + end)
            docs.append(doc)
            held += len(x) // 4 + 1
            if held >= shard_tokens:
                yield flush()
                ids, docs, held, seq = [], [], 0, seq + 1
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, path: str, name: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000) -> None:
    """Writes the ids of all texts, each followed by ``end_id``, as wavelet-matrix files in ascending id order.

    Documents are dealt by ranges of their id and sorted inside a range; a task closes a file after ``shard_tokens``
    tokens (or one longer document), so a file's size does not follow the range's. Spark's Parquet writer carries
    each file as one binary row: its commit makes a repeated task harmless, and any store Spark knows will do.
    Null text is empty (the end id alone). Rows without an id are refused, since the order is by id. Rows repeating an
    id stand side by side in the order of their texts. No rows give no files.
    """
    rows = docs.select(F.coalesce(id_col, F.raise_error(F.lit("a document without an id")).cast("long")).alias(id_col), text_col)
    rows.repartitionByRange(id_col).sortWithinPartitions(id_col, text_col).mapInArrow(
        lambda it: _shards(it, id_col, text_col, name, end_id, shard_tokens), SHARD,
    ).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, body in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("body")):
            m = WaveletMatrix.from_bytes(body.as_py())
            ids = memoryview(m.tokens().astype("<u4").tobytes())
            ends = [*m.starts[1:].tolist(), m.n]
            rows = [(doc, s, e - s, zlib.crc32(ids[4 * s:4 * e])) for doc, s, e in zip(m.doc_ids.tolist(), m.starts.tolist(), ends)]
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int64()), pa.array([seq] * k, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["_part", "_seq", "doc_id", "_start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 of every document in the files.

    Starts come from two small sums: over the parts (one row each) and over the files inside a part.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "n_tokens")
    totals = sizes.groupBy("_part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", "_seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_inside"))
    bases = bases.join(totals, "_part").select("_part", "_seq", (F.col("_base") + F.col("_inside")).alias("_base"))
    found = shards.select("part", "seq", "body").mapInArrow(_read, "_part long, _seq long, doc_id long, _start long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["_part", "_seq"]).select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
