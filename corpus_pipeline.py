"""From documents to packed training sequences: quality, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm.common import bundled, documents, lower_ascii, new_folder, unbundled
from surveyspark.llm.exact import exact_dedup
from surveyspark.llm.forest import near_duplicates
from surveyspark.llm.ordinal import classify, ratings_of, train
from surveyspark.llm.packing import pack
from surveyspark.llm.suffixes import remove_repeats


def _slim(docs: DataFrame) -> DataFrame:
    """Id, text, and all other columns as one, so that none of their names meets a name of the operators."""
    return docs.select("doc_id", "text", bundled(_others(docs), "_others"))


def _whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    d = rows.select("doc_id", "text", *unbundled(_others(docs), "_others"))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade (sound and clean) is at least one half."""
    slim = _slim(docs)
    model = train(slim, ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), grades=3)
    return _whole(classify(slim, model, at_least=2).filter("kept"), docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ at most in the case of A-Z, the one with the smallest id."""
    return _whole(exact_dedup(_slim(docs), lower_ascii(F.coalesce("text", F.lit("")))).filter("kept"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 similarity of their 5-word shingles, the one with the smallest id.

    Rows are judged one by one: a null id stays unless its shingles are those of a document with an id, and of rows that
    repeat an id each goes whose own shingles lead to a smaller id.
    """
    return _whole(near_duplicates(_slim(docs), width=5, percent=80, carry=["doc_id", "text", "_others"]), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 50 or more that a smaller id holds; those that had nothing else go."""
    cut = remove_repeats(_slim(docs), carry=["doc_id", "_others"], as_text="text").filter("n_removed = 0 or length(text) > 0")
    rest = _whole(cut, docs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: No SQL: a fitted classifier and a tokenizer decide. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
