"""Prefix trie, whitening and nearest neighbours against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.llm.conversations import conversation_trie, oracle_sql
from surveyspark.llm.hilbert import hilbert_keys, nearest_neighbours
from surveyspark.llm.radix import RadixTree
from surveyspark.llm.spectrum import inertia, leading
from surveyspark.llm.whitening import fit, whiten

EMPTY = hashlib.sha256().hexdigest()


def trie(rows):
    """Nodes of the rebuilt conversations, by dictionaries of whole prefixes."""
    by = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        by.setdefault(c, []).append((turn is not None, turn or 0, role, name, text))
    by = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items() if c is not None}
    sequences, members, kids, leaves, saved = {}, {}, {}, {}, {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        sequences[c] = tuple(by.get(c - int(math.fmod(c, 5)), [])[:h] + by[c][h:])
        for d in range(len(sequences[c]) + 1):
            members.setdefault(sequences[c][:d], []).append(c)
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[j] for j in kids.get(k, []))
        leaves[k] = sum(leaves[j] for j in kids.get(k, [])) or 1
        if k:
            kids.setdefault(k[:-1], []).append(k)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if sequences[c] == k).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], ends(k)) for k, m in members.items()), key=repr)


def nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.fixture
def many_ranges(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_trie_with_copies_over_many_ranges(spark, many_ranges):
    rng = random.Random(5)
    texts = ["", "a", "ab", "long " * 300, "ü", None]
    rows = []
    for c in range(300):
        kind = rng.random()
        length = 3 if kind < 0.5 else rng.randrange(1, 12)
        for turn in range(length):
            rows.append((c - 20, turn, "user", "same") if kind < 0.5 else (c - 20, rng.choice([turn, turn, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(7, 3, "user", "x"), (7, 3, "user", "x"), (None, 1, "user", "nobody"), (1001, 0, "user", "no base")]
    rows += [(5000, i, "user", str(i % 7)) for i in range(400)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    assert nodes(conversation_trie(df)) == trie(rows)


def test_trie_sql_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert nodes(conversation_trie(df)) == sorted(duckdb.sql(oracle_sql()).fetchall(), key=repr)
    assert conversation_trie(df.limit(0)).collect() == []
    turnless = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")  # its first turns come from 0, which is absent
    assert nodes(conversation_trie(turnless)) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_radix_tree_holds_what_a_dictionary_holds():
    rng = random.Random(3)
    keys = {bytes(rng.choice([0, 1, 7, 255, rng.randrange(256)]) for _ in range(2 * rng.randrange(0, 5))) for _ in range(4000)} | {bytes([i, j]) for i in range(3) for j in range(256)}
    tree, order = RadixTree(), sorted(keys)
    rng.shuffle(order)
    for k in order:
        tree.insert(k, k.hex() or "root")
    assert all(tree.get(k) == (k.hex() or "root") for k in keys)
    assert tree.get(b"\1\2\3\4\5\6\7\10\11\12") is None
    rooms = {n.room for n, _, _ in tree.upward()}
    assert rooms == {4, 16, 48, 256}
    assert sum(n.value is not None for n, _, _ in tree.upward()) == len(keys)


def test_inertia_and_leading_pairs():
    rng = np.random.default_rng(0)
    for diagonal in ([5.0, 5, 5, 3, 3, 2, 1, 1, 1, 0, 0], [1.0], [4.0, 4 - 1e-9, 1e-3], rng.random(40) * 100):
        q, _ = np.linalg.qr(rng.standard_normal((len(diagonal),) * 2))
        m = q @ np.diag(diagonal) @ q.T
        m = (m + m.T) / 2
        assert inertia(m, 2.5)[0] == sum(x > 2.5 for x in diagonal)
        e, u = leading(m, 16)
        wanted = sorted((x for x in diagonal if x > 0), reverse=True)[:16]
        assert np.allclose(e, wanted, rtol=1e-12, atol=1e-12)
        assert np.allclose(m @ u, u * e, atol=1e-11) and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
    assert inertia(np.array([[0.0, 1], [1, 0]]), 0.0) == (1, 0, 1)
    assert len(leading(np.zeros((3, 3)), 16)[0]) == 0


def whitened_by_numpy(rows):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    fit_list = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit_list), fit_list.sum(0)
    y = ((n * fit_list - s) / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return n, e, ((n * x - s) / n).astype(float) @ u, ((n * x - s) ** 2).sum(1)


@pytest.mark.parametrize("far", [1.0, 3e7])
def test_whitening(spark, far):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((300, 5)) * [9, 5, 3, 2, 1] * far).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(900, 1200)] + [(0, base[0])]
    odd = [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0]), (3, [float("nan")] * 5), (4, [float("inf")] * 5), (5, []), (6, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, component string").repartition(7)
    got = whiten(df).collect()
    n, e, w, deviation = whitened_by_numpy(rows)
    assert len(got) == 5 * len(rows) and all(r["n"] == n and r["identity_error"] < 1e-9 for r in got)
    want = {i: k for k, (i, _) in enumerate(rows)}
    signs = {}
    for r in got:
        c, k = r["component"] - 1, want[r["vec_id"]]
        expected = w[k, c] / math.sqrt(e[c])
        if abs(expected) > 1e-3:
            assert signs.setdefault(c, np.sign(expected * r["whitened"])) == np.sign(expected * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(expected)) < 1e-8
        assert abs(r["explained"] - e[c] / e.sum()) < 1e-12
        assert r["deviation"] == (deviation[k] if deviation[k] < 2**63 else None)


def test_whitening_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whiten(df).collect() == [] and whiten(df.limit(0)).collect() == [] and fit(df.filter("false")) is None
    two = spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["component"], abs(round(r["whitened"], 9)), r["deviation"]) for r in whiten(two).collect()) == [(0, 1, 1.0, 128**2), (1, 1, 1.0, 128**2)]


def neighbours_by_brute_force(rows, k):
    """Places keep repeated rows apart."""
    out = {}
    for p, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((math.dist(v, u), j) for q, (j, u) in enumerate(rows) if q != p)[:k]
            out.setdefault(i, []).append(near)
    return out


def test_hilbert_curve_steps_to_neighbours():
    for k, bits in ((1, 4), (2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=k)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(2 ** (bits * k)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_of_copies_and_ties(spark, many_ranges):
    """A third of the rows is one vector; grid vectors tie; odd rows take no part."""
    rng = random.Random(1)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(0, 400)]
    rows += [(i, [float(rng.randrange(5)), float(rng.randrange(5)), 1.0]) for i in range(400, 900)]
    rows += [(i, [rng.random() * 9, rng.random() * 9, rng.random()]) for i in range(900, 1200)] + [(500, [1.0, 1.0, 0.5])]
    odd = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (700, [float("nan"), 1.0, 1.0]), (800, [1.0, 1.0]), (None, [1.0, 1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["score"], r["vec_id"]))
    want = neighbours_by_brute_force(rows, 10)
    assert got.keys() == want.keys()
    for q, lists in want.items():
        for rank in range(10):
            rounded = lambda near: sorted((round(s, 9), j) for s, j in near)
            assert rounded(got[q][rank + 1]) == rounded(x[rank] for x in lists), (q, rank)


def test_neighbour_recall_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()}
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want = {(q, j): s for q, lists in neighbours_by_brute_force(rows, 10).items() for near in lists for s, j in near}
    assert len(want.keys() & got.keys()) >= 0.95 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want.keys() & got.keys())
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert nearest_neighbours(df, F.lit(False)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest_neighbours(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, round(5**0.5, 9))]
    alone = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert nearest_neighbours(alone, F.col("vec_id") % 100 == 0).collect() == []
