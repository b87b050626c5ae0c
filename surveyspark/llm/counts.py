"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bundled, carried, lower_ascii, unbundled
from .tokens import encoded

CACHE = "digest binary, version binary, n_tokens long"


def tokenizer_version(name: str) -> bytes:
    """Digest of the vocabulary file and the library that reads it."""
    import public_tokenizers
    import tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).digest()


def normalised(text: Column, name: str) -> Column:
    """Content that decides the count. The word vocabulary folds case, so ASCII texts without special strings do so too."""
    text = F.coalesce(text, F.lit(""))
    if not name.startswith("word"):
        return text
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("<|"))
    return F.when(plain, lower_ascii(text)).otherwise(text)


def _count(batches: Iterator[pa.RecordBatch], name: str, version: bytes) -> Iterator[pa.RecordBatch]:
    for b, ids in encoded(batches, "_text", name):
        yield pa.RecordBatch.from_arrays(
            [b.column("_digest"), pa.array([version] * len(ids), pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["digest", "version", "n_tokens"],
        )


def token_counts(docs: DataFrame, cache: str, name: str = "word_bpe_49k.json", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of every row (all by default) with ``n_tokens`` of its whole text; the cache at ``cache`` grows by the misses.

    Digests of the content are grouped (copies collapse to one row a map task before the shuffle, however hot), the
    stored counts of this tokenizer version are taken off by an anti-join on the same partitioning, and only the
    distinct rest is encoded and appended as Parquet. Counts return to the rows by digest; the rows are small and
    adaptive execution splits a hot digest. A job that is run again finds the first run's appended counts; if two jobs
    append the same digest, readers take one.

    Null text counts as empty (0 tokens, cached like any other). Extra columns may have any names; a carried ``n_tokens``
    gives way to the new one. No rows give no rows and an untouched cache.
    """
    spark: SparkSession = docs.sparkSession
    version = tokenizer_version(name)
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache)

    def stored() -> DataFrame:
        found = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == F.lit(version))
        return found.groupBy(F.col("digest").alias("_digest")).agg(F.max("n_tokens").alias("n_tokens"))

    keep = carried(docs.columns if carry is None else carry, ["n_tokens"])
    rows = docs.select(bundled(keep), normalised(F.col(text_col), name).alias("_text")).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    distinct = rows.groupBy("_digest").agg(F.first("_text").alias("_text"))
    misses = distinct.join(stored(), "_digest", "left_anti").select("_digest", "_text")
    misses.mapInArrow(lambda it: _count(it, name, version), CACHE).write.mode("append").parquet(cache)
    return rows.select("_row", "_digest").join(stored(), "_digest", "left").select(*unbundled(keep), "n_tokens")
