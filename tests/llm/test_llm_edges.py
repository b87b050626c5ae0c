"""Columns with clashing names, repeated rows, nulls and empty tables through every operator and the whole pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from surveyspark.llm.bands import compression_bands
from surveyspark.llm.counts import token_counts
from surveyspark.llm.exact import exact_dedup
from surveyspark.llm.forest import near_duplicates
from surveyspark.llm.license import scan_licenses
from surveyspark.llm.merges import encode_pieces
from surveyspark.llm.ordinal import classify, train
from surveyspark.llm.packing import pack
from surveyspark.llm.suffixes import remove_repeats

CLASHING = ["kept", "score", "_id", "_text", "n_removed", "group_size", "keep_id", "_row", "_others", "n_tokens", "ids", "n_words", "_hash", "a.b", "_md5", "d", "label"]


@pytest.fixture
def docs(spark):
    words = "the quick brown fox jumps over a lazy dog while seven wizards brew potent ale under the old stone bridge".split()
    texts = [" ".join(words), " ".join(words), " ".join(words[::-1]), None, "", "  ", "mit license " + " ".join(words[3:15])]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(None, "alone and without an id", "en", "web", 23), (6, texts[6], "en", "web", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHING):
        d = d.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return d.repartition(3)


def test_stages_carry_any_names(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHING), name
    assert pack(docs).count() == docs.count()


def test_operators_with_clashing_names(spark, docs, tmp_path):
    docs = docs.drop("a.b")  # mapInArrow itself takes no names with dots; the pipeline, which bundles columns, does
    none = spark.createDataFrame([], "doc_id long, grade int")
    made = {
        "classify": (classify(docs, train(docs, none, grades=3), at_least=2), ["score", "expected_grade", "tail_probability", "kept"]),
        "exact": (exact_dedup(docs, F.coalesce("text", F.lit(""))), ["keep_id", "group_size", "kept"]),
        "bands": (compression_bands(docs), ["n_words", "kept", "ratio"]),
        "counts": (token_counts(docs, str(tmp_path / "cache")), ["n_tokens"]),
        "merges": (encode_pieces(docs, verify=True), ["ids", "lossless"]),
        "repeats": (remove_repeats(docs, carry=docs.columns, as_text="text"), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    }
    for name, (out, new) in made.items():
        assert len(set(out.columns)) == len(out.columns), name
        rows = out.collect()
        assert len(rows) == docs.count(), name
        same = [c for c in CLASHING if c in out.columns and c not in {*new, "n_words"}]
        assert all(r[c].startswith(f"{c} of ") for r in rows for c in same) and len(same) > 10, name
        assert all(not str(r[c]).startswith(f"{c} of ") for r in rows for c in new), name


def test_one_row_in_one_row_out(spark, docs):
    """Rows that repeat an id and text are rows of the result too."""
    got = [tuple(r) for r in scan_licenses(docs).collect()]
    assert len(got) == docs.count()
    assert sum(r[0] == 6 for r in got) == 2 and len({r for r in got if r[0] == 6}) == 1
    assert len(near_duplicates(docs, width=2).collect()) == docs.count()
    sizes = {(r["doc_id"], r["group_size"]) for r in exact_dedup(docs, F.coalesce("text", F.lit(""))).collect()}
    assert (6, 2) in sizes and (3, 2) in sizes


def test_empty_table_through_the_pipeline(spark, docs, tmp_path):
    docs.filter("false").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_from_end_to_end(spark, docs, tmp_path):
    """Without labels all documents are kept by the classifier; copies and null texts meet, passages go once."""
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 2, 3, 5, None} <= got and not got & {1, 4}
