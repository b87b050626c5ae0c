"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesets import slices
from .common import carried, named, schema_of

_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Accepted range of compressed size / size by length in bytes; shorter texts than the first bound have no verdict.

    Natural prose shrinks the better the longer it is, so both limits fall with the length. Texts below the range
    repeat themselves, texts above it (encoded or random data) have no language in them.
    """

    bounds: tuple[int, ...] = (256, 1024, 4096, 16384, 65536)
    lowest: tuple[float, ...] = (0.36, 0.34, 0.32, 0.29, 0.27)
    highest: tuple[float, ...] = (0.92, 0.72, 0.70, 0.68, 0.66)
    chunk: int = 4096
    #: Share of chunks outside their band at which the document goes.
    bad_chunks: float = 0.5
    level: int = 3

    def limits(self, n: int) -> tuple[float, float] | None:
        k = bisect_right(self.bounds, n) - 1
        return None if k < 0 else (self.lowest[k], self.highest[k])

    def outside(self, n: int, ratio: float) -> bool:
        limits = self.limits(n)
        return limits is not None and not limits[0] <= ratio <= limits[1]


def ratios(data: bytes, bands: Bands, squeeze) -> tuple[float, int, int]:
    """Ratio of the whole (1 where empty), chunks, and how many of them lie outside their band."""
    n = len(data)
    if not n:
        return 1.0, 0, 0
    whole = len(squeeze(data)) / n
    if n <= bands.chunk:
        return whole, 1, int(bands.outside(n, whole))
    view = memoryview(data)
    parts = [view[i:i + bands.chunk] for i in range(0, n, bands.chunk)]
    if len(parts[-1]) < bands.chunk // 2:  # a short tail is judged with the chunk before it
        parts[-2:] = [view[(len(parts) - 2) * bands.chunk:]]
    return whole, len(parts), sum(bands.outside(len(p), len(squeeze(p)) / len(p)) for p in parts)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and words inside repeated 5-word windows."""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x and _WORD.search(x)]
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            seen, until = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 5 - max(i, until)
                    until = i + 5
    return n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def _judge(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], bands: Bands) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=bands.level).compress
    for b in slices(batches, text):
        cols = [[] for _ in range(10)]
        for t in b.column(text).to_pylist():
            counts = base_counts(t or "")
            failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
            data = (t or "").encode()
            whole, chunks, bad = ratios(data, bands, squeeze)
            fits = not bands.outside(len(data), whole) and bad < bands.bad_chunks * max(1, chunks)
            for c, v in zip(cols, (*counts, failed, whole, chunks, bad, fits and not failed)):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed ratio n_chunks bad_chunks kept".split()
        yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], keep + names)


def compression_bands(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, bands: Bands = Bands()) -> DataFrame:
    """Columns ``carry`` of every row (all but the text by default) with base counts, ratios and the verdict ``kept``.

    One pass without a shuffle; each text is read whole, a slice of two megabytes (or one longer document) at a time.
    Null text counts as empty: no words, ratio 1, base failed. Of a carried column named like a new one,
    the new one stays. No rows give no rows.
    """
    new = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed ratio n_chunks bad_chunks kept".split()
    keep = carried([c for c in docs.columns if c != text_col] if carry is None else carry, new)
    out = schema_of(docs, keep, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, bad_chunks long, kept boolean")
    return docs.select(*named(list(dict.fromkeys([*keep, text_col])))).mapInArrow(lambda it: _judge(it, text_col, keep, bands), out)
