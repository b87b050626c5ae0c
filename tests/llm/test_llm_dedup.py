"""Exact, near and substring deduplication and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyspark.llm import forest, suffixes
from surveyspark.llm.bytesets import hashes, runs, NOT_SPACE
from surveyspark.llm.common import lower_ascii
from surveyspark.llm.exact import exact_dedup
from surveyspark.llm.forest import near_duplicates
from surveyspark.llm.induced import InducedSorter
from surveyspark.llm.packing import best_fit, pack
from surveyspark.llm.suffixes import remove_repeats, spark_hash

SCHEMA = "doc_id long, text string, kept string"


def test_word_hashes():
    data = np.frombuffer(b"ab cd ab\nab", np.uint8)
    s, e, doc = runs(data, np.array([0, 5, 11]), NOT_SPACE)
    assert list(zip(s, e, doc)) == [(0, 2, 0), (3, 5, 0), (6, 8, 1), (9, 11, 1)]
    h = hashes(data, s, e)
    assert h[0] == h[2] == h[3] != h[1]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows = [(1, "Aé b"), (2, "aé B"), (3, "aÉ b"), (4, None), (5, ""), (6, "z" * 50000), (7, "Z" * 50000), (8, "aé b"), (8, "aé b"), (None, ""), (None, "alone")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(4)
    got = exact_dedup(df.withColumnRenamed("kept", "x"), lower_ascii(F.col("text")), keep=keep, carry=["doc_id", "text"]).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    pick = min if keep == "smallest" else max
    want = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        k = pick(ids) if ids else None
        want.append((i, t, k, len(groups[low(t)]), i == k))
    assert Counter(map(tuple, got)) == Counter(want)
    assert exact_dedup(df.limit(0), F.col("text")).collect() == []


def jaccard_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j:j + width]) for j in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 30, 120, 300]))
        for _ in range(rng.randint(1, 9)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.04, 0.1]) else w for w in base]
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy)))
    base = rng.choices(vocabulary, k=100)  # a group larger than a block and a chunk
    for _ in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(4)
    for width in (2, 5):
        got = sorted(map(tuple, near_duplicates(df, width=width).collect()))
        assert got == jaccard_groups(rows, width, 80)
    assert near_duplicates(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "x y")], "doc_id long, text string")
    assert sorted(map(str, near_duplicates(twice).collect())) == sorted([
        "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)", "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)",
        "Row(doc_id=None, n_shingles=2, component_id=5, kept=False)", "Row(doc_id=7, n_shingles=1, component_id=7, kept=True)",
    ])


def test_near_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 2)  # nearly all regions are crowded, as in a large input
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base, rows, want = [word() for _ in range(200)], [], {}
    for _ in range(600):  # any two share about 0.38, far too little for a link
        rows.append((len(rows), " ".join(rng.sample(base, 110))))
    for i in range(600):  # one near copy of each, at 98 of 122 words
        words = rng.sample(rows[i][1].split(), 98)
        want[len(rows)] = i
        rows.append((len(rows), " ".join(words + rng.sample(sorted(set(base) - set(rows[i][1].split())), 12))))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: want.get(i, i) for i, _ in rows}


def test_near_chunks_stay_small(spark, monkeypatch):
    sizes, links = [], forest._links

    def seen(rows, *more):
        sizes.append(rows.groupBy("cluster", "chunk").count().agg(F.max("count")).first()[0])
        return links(rows, *more)

    monkeypatch.setattr(forest, "CHUNK", 16)
    monkeypatch.setattr(forest, "_links", seen)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(word() if rng.random() < 0.15 else w for w in base)) for i in range(300)]  # about 0.74: candidates, seldom links
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=1).collect()
    assert sorted(map(tuple, got)) == jaccard_groups(rows, 1, 80)
    assert max(sizes) < 64  # 16 on average and 8 pivots


def test_near_copies_by_row(spark):
    import corpus_pipeline

    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(1, t[0], 9), (2, t[0] + " more", 9), (3, t[1], 9), (3, t[0], 9), (None, t[2], 9), (None, t[0], 9), (None, None, 9), (4, None, 9), (5, "", 9), (6, t[3], 9), (6, t[3], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r not in {(2, t[0] + " more", 9), (3, t[0], 9), (None, t[0], 9)})


def test_induced_sorting():
    rng = random.Random(3)
    for _ in range(400):
        b = bytes(rng.choices(rng.choice([b"ab", b"abc", b"a", b"\x00a\xff", bytes(range(20))]), k=rng.randint(1, 120))) * rng.choice([1, 1, 3])
        depth = rng.choice([3, 8, 16, 50])
        pos, lcp = InducedSorter(np.frombuffer(b, np.uint8), depth, memory=2048).order()
        padded = b + b"\x01" + bytes(100)
        keys = [padded[p:p + depth] for p in pos]
        assert sorted(pos.tolist()) == list(range(len(b))) and keys == sorted(keys)
        for x, y, n in zip(keys, keys[1:], lcp[1:].tolist()):
            assert x[:n] == y[:n] and (n == depth or x[n] != y[n])


def removed(rows, length):
    best, out = {}, []
    top = 2**63 - 1
    rows = [(top if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in rows:
        for i in range(len(b) - length + 1):
            best[b[i:i + length]] = min(best.get(b[i:i + length], top), d)
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if best[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if d == top else d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def test_repeats(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(12)]
    rows = []
    for i in range(200):
        t = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += p[a:a + rng.randint(20, 300)] + " ".join(rng.choices(words, k=rng.randint(0, 5)))
        rows.append((i * 7 % 200, t))
    rows += [(400, None), (401, ""), (402, "a" * 500), (403, "b" + "a" * 120), (404, "ab" * 200), (405, "x" + "ab" * 80), (406, rows[0][1]), (407, rows[0][1]), (407, rows[0][1]), (None, rows[1][1])]
    rows += [(500 + i, "hello world this is a repeated sentence for all. " * 3 + str(i)) for i in range(20)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    for sizes in ({}, {"shard_bytes": 4000, "group_bytes": 3000}):
        got = remove_repeats(df, **sizes).collect()
        assert Counter(map(tuple, got)) == removed(rows, 50)
    texts = remove_repeats(df, carry=["doc_id", "text", "kept"], as_text="rest").collect()
    assert Counter((r["doc_id"], r["text"], r["kept"]) for r in texts) == Counter((i, t, "clash") for i, t in rows)
    assert all(r["rest"] == r["text"] for r in texts if not r["n_removed"])
    assert remove_repeats(df.limit(0)).collect() == []
    x = [0, 1, 5, -7, 2**40]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in x], "a long").select(F.xxhash64("a")).collect()] == spark_hash(np.array(x)).tolist()


def test_only_what_may_repeat_is_sorted(monkeypatch):
    """A phrase stands in 300 texts among other letters each time; only two of them share more than the phrase."""
    rng = random.Random(2)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    phrase, tail = some(40), some(60)
    rows = [(i, some(60) + phrase + some(60)) for i in range(300)] + [(i, some(60) + phrase + tail) for i in (300, 301)]
    one = suffixes.Keys(1, 1)
    docs = pa.table({"d": [i for i, _ in rows], "text": [t for _, t in rows], "grp": [0] * len(rows)})
    grams = pa.Table.from_batches(suffixes._grams(iter(docs.select(["d", "text"]).to_batches()), 50, one, one)).to_batches()
    info = pa.Table.from_batches(suffixes._shared(iter(grams), one, one))
    contexts = suffixes._contexts(docs, info, 50, one)
    sent = sum(len(suffixes._unpack(b, np.uint32, *suffixes._CONTEXT)[-1]) for b in contexts.column("blob").to_pylist())
    sorted_, plain = [], suffixes.classes
    monkeypatch.setattr(suffixes, "classes", lambda text, at, depth: sorted_.append(len(text)) or plain(text, at, depth))
    decided = pa.Table.from_batches(suffixes._decide(iter(contexts.to_batches()), 50, one))
    assert sent > 300 * 50 and 0 < sum(sorted_) < sent / 20
    cut = pa.Table.from_batches(suffixes._cut(docs, decided, 50, ["d"], None))
    assert Counter(map(tuple, (r.values() for r in cut.to_pylist()))) == removed(rows, 50)


def test_blobs_grow_with_the_text(spark):
    """Sixteen times the text in shards and groups of one size makes sixteen times the blobs, not 256 times; results stay."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(500)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + " " + rng.choice(passages)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, remove_repeats(df, shard_bytes=2000, group_bytes=3000, buckets=4).collect())) == removed(rows, 50)
    shards, groups = suffixes.Keys(600, 150), suffixes.Keys(400, 100)
    docs = pa.table({"d": [i for i, _ in rows], "text": [t for _, t in rows]})
    grams = pa.Table.from_batches(suffixes._grams(iter(docs.to_batches()), 50, shards, groups)).to_pylist()
    assert len(grams) <= 4 + 4 and {r["key"] for r in grams} <= set(range(4))
    cut = pa.Table.from_batches(suffixes._by_key(iter(pa.Table.from_pylist(grams).to_batches()), 150, suffixes._GRAM, False))
    assert max(cut.column("key").to_pylist()) < 600 and len(set(cut.column("key").to_pylist())) > 300
    told = [r for r in cut.to_pylist() if r["gb"] >= 0]
    assert sorted((r["gb"], r["blob"]) for r in told) == sorted((r["gb"], r["blob"]) for r in grams if r["gb"] >= 0)


def test_best_fit():
    rng = np.random.default_rng(1)
    for window in (16, 100, 2048):
        n = rng.integers(1, window + 1, 300)
        where, at = best_fit(n, window)
        free = []
        for i in np.argsort(-n, kind="stable"):  # the tightest window, by looking at all
            fits = [c for c in free if c >= n[i]]
            if fits:
                free.remove(min(fits))
            rest = (min(fits) if fits else window) - n[i]
            free += [rest] if rest else []
        used = np.bincount(where, n)
        assert sorted((window - used[used < window]).astype(int).tolist()) == sorted(int(x) for x in free)
        for w in range(where.max() + 1):
            i = np.flatnonzero(where == w)
            i = i[np.argsort(at[i])]
            assert at[i].tolist() == (np.cumsum(n[i]) - n[i]).tolist() and n[i].sum() <= window


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "the", "of"], k=rng.choice([0, 5, 60, 300])))) for i in range(120)] + [(200, None), (201, "word " * 5000), (201, "word " * 5000), (None, "x y z")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(4)
    got = pack(df, shard_pieces=40, with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            p = ids[s:s + 2048].tobytes()
            want[i, s, len(p) // 4, zlib.crc32(p), len(ids), p] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 2048
    assert pack(df.limit(0)).collect() == []
