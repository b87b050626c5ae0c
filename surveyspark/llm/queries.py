"""Named queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .bands import compression_bands
from .common import documents, lower_ascii, new_folder
from .conversations import conversation_trie, oracle_sql as trie_sql
from .counts import token_counts
from .exact import exact_dedup
from .forest import near_duplicates
from .hilbert import nearest_neighbours
from .license import oracle_sql as license_sql, scan_licenses
from .merges import encode_pieces
from .ordinal import classify, ratings_of, train
from .packing import pack
from .suffixes import remove_repeats
from .wavelet import read_token_files, write_token_files
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


@query
def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80)


ORACLE["op3_lsh_forest"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 1], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words)))) AS p FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


@query
def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir), carry=["doc_id"])


@query
def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), grades=3)
    return classify(docs, model, at_least=2, carry=["doc_id"])


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


ORACLE["op6_license_scan"] = license_sql()


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("text"))
    docs = docs.withColumn("text_sha256", F.sha2("text", 256))
    return exact_dedup(docs, F.col("text"), keep="largest", carry=["doc_id", "text_sha256"])


ORACLE["op7_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


@query
def op8_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = token_counts(docs, new_folder(spark, "token-cache"), carry=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksum of the sampled ids of every text, and whether they decode to it."""
    docs = documents(spark, sf_dir).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    rows = encode_pieces(docs, dropout=0.1, seed=1, carry=["doc_id", "n_bytes"], verify=True)
    return rows.select("doc_id", "n_bytes", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "lossless")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE["op11_conversation_trie"] = trie_sql()


@query
def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), carry=["vec_id"])


@query
def op13_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
