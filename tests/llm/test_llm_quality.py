"""Classifier on held-out labels, licence scan against SQL, the pipeline and the registration."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from surveyspark.llm.common import documents
from surveyspark.llm.license import oracle_sql, scan_licenses
from surveyspark.llm.ordinal import classify, ratings_of, train
from surveyspark.llm.queries import ORACLE, QUERIES

from test_llm_dedup import jaccard_groups, removed


def test_held_out_grades(spark):
    sf = "/root/testdata/sf0.1"
    docs, ratings = documents(spark, sf), ratings_of(spark.read.parquet(f"{sf}/labels.parquet"))
    rest = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    model = train(docs, ratings.filter(~rest), grades=3)
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    rows = classify(docs.join(ratings.filter(rest), "doc_id"), model, at_least=2, carry=["doc_id", "grade", "text"]).collect()
    share = lambda ok, of: sum(ok(r) for r in of) / len(of)
    by = {g: [r for r in rows if r["grade"] == g] for g in range(3)}
    assert share(lambda r: r["kept"], by[2]) > 0.98
    assert share(lambda r: not r["kept"], by[1]) > 0.85
    assert share(lambda r: not r["kept"], by[0]) > 0.75  # a third of these labels stand on texts without any such word
    insults = re.compile(r"\b(moron|clown|loser|pathetic|scum|trash|idiot|disgusting|stupid|worthless)\b")
    plain = [r for r in by[0] if len(set(insults.findall(r["text"].lower()))) > 1]
    assert len(plain) > 50 and share(lambda r: not r["kept"], plain) > 0.97
    mean = {g: sum(r["expected_grade"] for r in x) / len(x) for g, x in by.items()}
    assert mean[0] < mean[1] < mean[2]


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "good plain text", "x"), (1, "good plain text", "x"), (2, None, None), (None, "", "y"), (3, "bad " * 20000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = classify(docs, train(docs, none, grades=3), at_least=2, carry=["doc_id"]).collect()
    assert len(got) == 5 and all(r["kept"] and r["score"] == 0 for r in got)
    some = spark.createDataFrame([(1, 2), (1, 2), (3, 0), (2, None), (None, 1)], "doc_id long, grade int")
    model = train(docs, some, grades=3)
    got = classify(docs, model, at_least=2, carry=["doc_id"])
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"]) == [1, 1, 2, 3]
    assert classify(docs.limit(0), model, at_least=2, carry=["doc_id"]).collect() == []


def test_licenses(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    rows = [
        (1, "x MIT License y. CC-BY and mit\nlicense"), (2, notice), (3, notice.replace("any person", "any other lucky person")), (4, "permission is hereby granted to nobody"), (5, None), (6, ""),
        (7, "the GNU General Public License, GNU general public license"), (8, "Licensed under CC BY-NC 4.0."), (9, "cc by " * 3000), (10, "émit license Ñ mit"), (11, "…  \t"), (2, notice),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, labels string").repartition(3)
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert len(got) == 11 and got[2]["labels"] == got[3]["labels"] == "mit" and got[2]["score"] == 1 and 0.7 <= got[3]["score"] < 1
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 7, "cc-by,mit")
    assert got[4]["labels"] == "" and 0 < got[4]["score"] < 0.7 and got[5]["n_words"] == got[6]["n_words"] == 0 and got[11]["n_words"] == 1 and got[5]["first_word"] is None
    assert (got[7]["n_base"], got[7]["labels"]) == (2, "gpl") and got[8]["labels"] == "cc-by,cc-by-nc" and got[9]["n_base"] == 3000
    assert got[10]["n_base"] == 0 and got[10]["n_words"] == 4
    con = duckdb.connect()
    documents_ = df.dropDuplicates(["doc_id"]).toPandas()
    con.register("documents", documents_)
    cur = con.execute(oracle_sql())
    names = [c[0] for c in cur.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cur.fetchall()}
    assert want == {k: r.asDict() for k, r in got.items()}
    assert scan_licenses(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    d = QUERIES[name](spark, sf)
    cols = sorted(d.columns)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert Counter(str(tuple(r[c] for c in cols)) for r in d.collect()) == Counter(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    """Each stage against its rule on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs, tables = documents(spark, sf), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf)
        assert rows.columns == docs.columns
        docs = spark.createDataFrame(rows.collect(), rows.schema)
        tables.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, exact, near, cut = tables
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in quality for i in good) >= 0.97 * len(good)
    first = {}
    for i in sorted(quality):
        first.setdefault(quality[i].lower(), i)
    assert sorted(exact) == sorted(first.values())
    assert sorted(near) == [i for i, _, _, kept in jaccard_groups(list(exact.items()), 5, 80) if kept]
    lost = {r[0]: r for r in removed(list(near.items()), 50)}
    assert all((cut[i] == near[i]) if lost[i][2] == 0 else len(cut[i]) < len(near[i]) for i in cut)
    assert set(near) - set(cut) == {i for i, r in lost.items() if r[2] == r[1] > 0}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(cut)
    assert random.Random(0).choice(packed)["length"] <= 2048
