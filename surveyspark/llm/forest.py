"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .bytesets import LOWER, NOT_SPACE, hashes, mix, runs, slices, text_bytes
from .common import bundled, deleted, release, unbundled, written
from .vectors import fold

#: Sorted signature orders and the MinHash values of each; a region starts at the first depth and deepens while crowded.
TREES, VALUES, DEPTHS = 16, 8, (3, 5, 8)
#: Documents of a block, in which all are compared by sketch, and of a chunk, in which sets are compared.
BLOCK, CHUNK = 64, 256
#: Estimated similarity from which two documents are candidates: five standard errors below 0.8.
CANDIDATE = 0.62
#: Counters of shingles by hash; their sums order shingles from rare to frequent.
COUNTERS = 1 << 18
_ODD = np.random.default_rng(20240229).integers(0, 2**63, (2, TREES * VALUES), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct word shingles of each text, ascending inside a document, and their counts.

    Words are runs of bytes other than ASCII white space with A-Z in lower case; fewer than ``width`` words make one shingle.
    """
    raw, off = text_bytes(column)
    data, n = LOWER[raw], len(column)
    starts, ends, doc = runs(data, off, NOT_SPACE)
    h = hashes(data, starts, ends)
    words = np.bincount(doc, minlength=n)
    first = np.append(0, np.cumsum(words))
    acc, at = np.full(len(h), np.uint64(width)), np.arange(len(h))
    left = first[1:][doc] - at  # words from here to the end of the document
    for j in range(width):
        inside = left > j
        acc[inside] = mix(acc[inside] * np.uint64(0xD6E8FEB86659FD93) + h[at[inside] + j])
    whole = (left >= width) | (at == first[:-1][doc])
    acc, doc = acc[whole], doc[whole]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[new], np.bincount(doc[new], minlength=n)


def _signatures(batches: Iterator[pa.RecordBatch], id_col: str, text: str, width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text):
        sets, counts = shingles(b.column(text), width)
        ends = np.cumsum(counts)
        some = counts > 0
        sig = np.zeros((len(counts), TREES * VALUES), np.uint32)
        if len(sets):
            at = (ends - counts)[some]
            for j in range(TREES * VALUES):
                sig[some, j] = np.minimum.reduceat((sets * _ODD[0, j] + _ODD[1, j]) >> np.uint64(32), at)
        low = (sig & np.uint32(15)).astype(np.uint8)
        sketch = low[:, ::2] | low[:, 1::2] << 4
        raw, sig = sets.tobytes(), sig.astype(">u4")  # big-endian bytes sort like the values
        rows = [
            (hashlib.md5(raw[8 * (e - c):8 * e]).digest(), sig[i].tobytes(), sketch[i].tobytes()) if c else (None, None, None)
            for i, (c, e) in enumerate(zip(counts.tolist(), ends.tolist()))
        ]
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("text_md5"), pa.array(counts, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["doc_id", "text_md5", "n_shingles", "digest", "sig", "sketch"])


def _runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut so that no run of equal keys is split, with the starts of the runs (and the end)."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        cut = edges(t)
        if len(cut):
            yield t.slice(0, cut[-1]), np.concatenate([[0], cut])
            held = t.slice(cut[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.concatenate([[0], edges(t), [t.num_rows]])


class _Union:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links inside each block of a sorted signature order, as few as hold its candidates together.

    Neighbours are compared first, then ever more distant places; what is already held together is skipped.
    """
    same = np.array([[(x >> s & 15) == 0 for s in (0, 4)] for x in range(256)]).sum(1).astype(np.uint8)  # equal halves of a byte, by exclusive or
    least = TREES * VALUES * (CANDIDATE + (1 - CANDIDATE) / 16)
    for t, cut in _runs_of(batches, ["block"]):
        n = t.num_rows
        node = t.column("rep").to_numpy()
        size = 8 * TREES * VALUES // 16
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, size)
        end = np.repeat(cut[1:], np.diff(cut))
        held, i = _Union(n), np.arange(n)
        for step in range(1, int(np.diff(cut).max(initial=0))):
            i = i[i + step < end[i]]
            close = i[same[sketch[i] ^ sketch[i + step]].sum(1, dtype=np.int64) >= least]
            for x in close.tolist():
                held.join(x, x + step)
        root = np.array([held.find(x) for x in range(n)], np.int64)
        least_id = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least_id, root, node)  # stars, so that few rounds find the components
        src = least_id[root]
        yield _edges(src[src != node], node[src != node])


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of full sets inside each chunk, as few as hold its components together; guests come first in a chunk."""
    for t, cut in _runs_of(batches, ["cluster", "chunk"]):
        parts = [shingles(b.column("text"), width) for b in slices(iter(t.combine_chunks().to_batches()), "text")]
        sets, counts = (np.concatenate(x) for x in zip(*parts))
        first = np.append(0, np.cumsum(counts))
        nodes, chunks = (t.column(c).to_numpy() for c in ("node", "chunks"))
        src, dst, whole = [], [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a < 2:
                continue
            names, local = np.unique(sets[first[a]:first[b]], return_inverse=True)
            at, size, m = first[a:b] - first[a], counts[a:b], b - a
            label = np.unique(nodes[a:b], return_inverse=True)[1]  # of each position; equal ids start alike
            mark, joined, sizes = np.zeros(len(names), np.int64), False, size
            for i in range(m):
                if (label == label[0]).all():
                    break
                mine = local[at[i]:at[i] + size[i]]
                mark[mine] = 1
                both = np.add.reduceat(mark[local], at)
                mark[mine] = 0
                linked = (100 * both >= percent * (size[i] + sizes - both)) & (label != label[i])
                if linked.any():
                    label[np.isin(label, label[linked])] = label[i]
                    joined = True
            if joined:
                least_id = np.full(m, np.iinfo(np.int64).max)
                np.minimum.at(least_id, label, nodes[a:b])
                star = least_id[label]
                src += star[star != nodes[a:b]].tolist()
                dst += nodes[a:b][star != nodes[a:b]].tolist()
                whole += [bool(chunks[a] == 1)] * (len(src) - len(whole))
        yield _edges(src, dst).append_column("whole", pa.array(whole, pa.bool_()))


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate links (src, dst) between class representatives: all sorted orders, each to the depth its regions need.

    Also the representatives (node) of regions too crowded at the first depth, whose deeper blocks do not hold all pairs.
    """
    bytes_ = 4 * VALUES
    rows = reps.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix = lambda d: F.xxhash64("tree", F.expr(f"substring(sig, tree * {bytes_} + 1, {4 * d})"))
    rows = rows.select("rep", "tree", *[prefix(d).alias(f"r{d}") for d in DEPTHS])
    taken, rest = [], rows
    for d in DEPTHS:
        crowd = rest.groupBy(f"r{d}").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("p0"), F.max("rep").alias("p1")).filter("n > 1")
        rest = rest.join(crowd, f"r{d}")
        taken.append(rest.filter(F.col("n") <= BLOCK).select("rep", "tree", F.col(f"r{d}").alias("block")))
        rest = rest.filter(F.col("n") > BLOCK)
        if d != DEPTHS[-1]:
            rest = written(rest.drop("n", "p0", "p1"), "crowded")  # small: what shares the prefix with many
        if d == DEPTHS[0]:
            crowded = rest.select(F.col("rep").alias("node")).distinct()
    # still crowded at full depth: dealt into blocks, each with two members that all blocks of the region share
    last = f"r{DEPTHS[-1]}"
    blocks = F.ceil(F.col("n") / BLOCK)
    taken.append(rest.select("rep", "tree", F.xxhash64(last, F.pmod(F.xxhash64("rep"), blocks)).alias("block")))
    pivots = crowd.filter(F.col("n") > BLOCK).join(rest.select(last, "tree").distinct(), last)
    pivots = pivots.select("tree", F.explode(F.array("p0", "p1")).alias("rep"), last, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"))
    taken.append(pivots.select("rep", "tree", F.xxhash64(last, "b").alias("block")))
    placed = taken[0]
    for t in taken[1:]:
        placed = placed.union(t)
    placed = placed.join(reps, "rep").select("rep", "block", F.expr(f"substring(sig, tree * {bytes_} + 1, {bytes_})").alias("key"), "sketch")
    placed = placed.repartition("block").sortWithinPartitions("block", "key", "rep")
    return placed.select("block", "rep", "sketch").mapInArrow(_neighbours, "src long, dst long").distinct(), crowded


def _counters(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles fall on each counter, over all texts: a sparse state a task, merged in a few steps."""

    def merge(a, b):
        at, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        return at[order][first], np.add.reduceat(n[order], first)

    def add(state, batch):
        for b in slices(iter([batch]), "text"):
            sets, _ = shingles(b.column("text"), width)
            n = np.bincount((sets % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            found = (np.flatnonzero(n), n[n > 0])
            state = found if state is None or not len(state[0]) else merge(state, found) if len(found[0]) else state
        return state

    out = np.zeros(COUNTERS, np.int64)  # of fixed size, whatever the input
    at, n = fold(texts.select("text"), add, lambda a, b: merge(a, b) if len(a[0]) and len(b[0]) else a if len(a[0]) else b) or ([], [])
    out[at] = n
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each text, of which two texts at ``percent`` share at least one, with their places."""
    for b in slices(batches, "text"):
        sets, counts = shingles(b.column("text"), width)
        doc = np.repeat(np.arange(len(counts)), counts)
        sets = sets[np.lexsort((sets, often[(sets % np.uint64(COUNTERS)).astype(np.int64)], doc))]
        size, place = counts[doc], np.arange(len(sets)) - (np.cumsum(counts) - counts)[doc]
        use = 100 * (size - place) >= percent * size
        yield pa.RecordBatch.from_arrays(
            [b.column(c).take(pa.array(doc[use])) for c in ("node", "comp", "many")] + [pa.array(x[use]) for x in (sets.view(np.int64), size, place)],
            ["node", "comp", "many", "shingle", "size", "place"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        sets, counts = shingles(b.column("text"), width)
        off = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(off, pa.array(sets.view(np.int64)))], ["node", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree as often as candidates' must."""
    same = np.array([[(x >> s & 15) == 0 for s in (0, 4)] for x in range(256)]).sum(1).astype(np.uint8)
    least = TREES * VALUES * (CANDIDATE + (1 - CANDIDATE) / 16)
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("a", "b"))
        close = pa.array(same[x ^ y].sum(1, dtype=np.int64) >= least)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(close) for c in ("src", "dst")], ["src", "dst"])


def _across(texts: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (src, dst) at ``percent`` between texts (node, comp, many, text) of different components, by a prefix join.

    Shingles are put in one order, rare ones first. If x is no larger than y and they are linked, the first shingle they
    share stands early in both: what begins there holds 2p / (1 + p) of x and p of y at least, and bounds what both can
    share. ``many`` is the size of the component: members of the largest that meet in a shingle need no comparison with
    one another. Of the pairs that pass, those whose ``sketches`` (rep, sketch) are as alike as candidates' must be are
    compared on their full sets; a pair at 0.8 fails that with the chance of five standard errors.
    """
    often = _counters(texts, width)
    rare = texts.mapInArrow(lambda it: _prefixes(it, width, percent, often), "node long, comp long, many long, shingle long, size long, place long")
    rare = written(rare, "prefixes")
    early = (100 + percent) * (F.col("size") - F.col("place")) >= 2 * percent * F.col("size")
    met = rare.groupBy("shingle").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("many", "comp")).getField("comp").alias("lead"), F.max(early).alias("any"))
    met = met.filter("lo <> hi and any").select("shingle", "lead")
    shared = rare.join(met, "shingle").select("node", "comp", "shingle", "size", "place", early.alias("early"), (F.col("comp") == F.col("lead")).alias("led"))
    shared = written(shared, "shared")
    y = shared.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("node", "comp", "size", "place", "led")])
    least = F.least(F.col("size") - F.col("place"), F.col("y_size") - F.col("y_place"))
    fits = (F.col("comp") != F.col("y_comp")) & ((F.col("size") < F.col("y_size")) | (F.col("size") == F.col("y_size")) & (F.col("node") < F.col("y_node")))
    fits &= (100 * F.col("size") >= percent * F.col("y_size")) & ((100 + percent) * least >= percent * (F.col("size") + F.col("y_size")))
    x = shared.filter("early").withColumnRenamed("shingle", "s")
    pairs = [a.join(b, (F.col("s") == F.col("shingle")) & fits) for a, b in ((x.filter("not led"), y), (x.filter("led"), y.filter("not y_led")))]
    pairs = pairs[0].union(pairs[1]).select(F.least("node", "y_node").alias("src"), F.greatest("node", "y_node").alias("dst")).distinct()
    seen = [sketches.select(F.col("rep").alias(k), F.col("sketch").alias(c)) for k, c in (("src", "a"), ("dst", "b"))]
    pairs = written(pairs.join(seen[0], "src").join(seen[1], "dst").mapInArrow(_alike, "src long, dst long"), "pairs")
    deleted(rare, shared)
    release(texts.sparkSession)
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    sets = written(texts.select("node", "text").join(nodes, "node").mapInArrow(lambda it: _sets(it, width), "node long, shingles array<long>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), "src")
    both = both.join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), "dst")
    both = both.withColumn("n", F.size(F.array_intersect("a", "b")))
    links = written(both.filter(100 * F.col("n") >= percent * (F.size("a") + F.size("b") - F.col("n"))).select("src", "dst"), "across")
    deleted(pairs, sets)
    return links


def _components(edges: DataFrame) -> DataFrame:
    """Components of the edges; only the last round's table stays."""
    last: list[DataFrame] = []

    def keep(e: DataFrame) -> DataFrame:
        last.append(written(e, "edges"))
        if len(last) > 1:
            deleted(last.pop(0))
        return last[-1]

    return connected_components(edges, keep)


def _members_in_chunks(clusters: DataFrame) -> DataFrame:
    """Members of candidate clusters, dealt evenly into chunks."""
    size = clusters.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"),
        *[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).getField("node").alias(f"p{i}") for i in range(8)],
    )
    rows = clusters.join(size, "component")
    return rows.select(
        F.col("component").alias("cluster"), "node", F.pmod(F.xxhash64("node", F.lit(77)), "chunks").alias("chunk"), "chunks",
        F.array_contains(F.array(*[f"p{i}" for i in range(8)]), F.col("node")).alias("pivot"),
    )


def _links(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    rows = rows.join(texts, "node").repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", F.col("guest").desc(), "node")
    rows = rows.select("cluster", "chunk", "chunks", "node", "text")
    return rows.mapInArrow(lambda it: _confirm(it, width, percent), "src long, dst long, whole boolean")


def _completed(found: DataFrame, open_: DataFrame, named: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """``found`` (node, component) with all links between the ``open_`` nodes, of which only some are found."""
    if open_.isEmpty():
        return found
    found = written(found, "found")
    labels = open_.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    labels = labels.join(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("many")), "comp")
    texts = named.select(F.col("doc_id").alias("node"), "text").join(labels, "node").select("node", "comp", "many", "text")
    texts = written(texts, "open")
    more = _across(texts, sketches, width, percent)
    deleted(texts)
    if more.isEmpty():
        return found
    of = written(labels.select("node", "comp"), "labels")
    more = more.join(of.select(F.col("node").alias("src"), F.col("comp").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("comp").alias("b")), "dst")
    joined = written(_components(more.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()), "joined")
    found = found.union(joined.select("node", F.col("node").alias("component"))).distinct()  # some stood alone
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return found.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, or columns ``carry`` of the kept rows; texts are linked at ``percent`` similarity of their shingle sets.

    1. Rows of one shingle set form a class by the set's 128-bit digest; only its smallest id goes on, so a group of
       copies of any size is one node.
    2. An LSH forest proposes candidates: in each sorted signature order, documents that share a prefix form a region;
       crowded regions deepen their prefix, and what is still crowded at full depth is dealt into blocks that share two
       members. In a block all are compared by sketch. Depth 3 of 16 orders loses a pair at 0.8 with a chance of 1e-5;
       pairs that deeper blocks part are found in step 4.
    3. Components of the candidates are clusters. Each is confirmed on full sets made anew from the texts: chunks of
       bounded size compare all their members, and a large cluster's chunks also its eight pivots.
    4. All members of regions crowded at depth 3 and of clusters of several chunks are joined by their rarest shingles with
       those of other components, and pairs with alike sketches are compared on full sets.
    5. Components of the confirmed links give ``component_id``, the smallest id reachable.

    Tables between the steps are written to the shared folder and deleted when the next stands; no group is gathered whole and nothing goes to the driver
    but counts. Null, empty and white-space texts have no shingles and are linked with nothing, equal ones included.
    Rows that repeat an id are one node. Other columns are not read, or carried under any names. A null id stays alone (component null, not kept unless alone by itself).
    No rows give no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("text_md5"))
    signed = named.mapInArrow(lambda it: _signatures(it, "doc_id", "text", width), "doc_id long, text_md5 binary, n_shingles long, digest binary, sig binary, sketch binary")
    signed = written(signed, "signatures")
    known = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "classes")

    candidates, crowded = _candidates(reps.select("rep", "sig", "sketch"))
    clusters = written(_components(candidates), "clusters")
    members = _members_in_chunks(clusters)
    texts = named.select(F.col("doc_id").alias("node"), "text").join(clusters.select("node"), "node")
    texts = written(texts, "candidates")
    own = members.select("cluster", "chunk", "chunks", "node", F.lit(False).alias("guest"))
    every = lambda rows: rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    guests = every(members.filter("pivot and chunks > 1").drop("chunk")).select("cluster", "chunk", "chunks", "node", F.lit(True).alias("guest"))
    links = written(_links(own.union(guests), texts, width, percent), "links")
    # a cluster of one chunk was seen whole: its links point from the smallest id; the root needs no row
    found = links.filter("whole").select(F.col("dst").alias("node"), F.col("src").alias("component")).distinct()
    parted = members.filter("chunks > 1")
    if not parted.isEmpty():
        found = found.union(_components(links.filter("not whole").select("src", "dst")))
    found = written(found, "confirmed")
    open_ = written(crowded.union(parted.select("node")).distinct(), "open-nodes")
    deleted(texts, links, clusters)
    release(docs.sparkSession)
    found = written(_completed(found, open_, named, reps.select("rep", "sketch"), width, percent), "components")
    of_class = reps.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("digest", F.coalesce("component", "rep").alias("_component"))
    if carry is None:
        return signed.join(of_class, "digest", "left").select(
            "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"),
        ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # a row goes by its id and text; repeated and null ids are told apart by the text
    gone = signed.join(of_class, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("_component")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct().alias("gone")
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text_col)).alias("_md5"), bundled(carry)).alias("rows")
    same = F.col("rows._id").eqNullSafe(F.col("gone._id")) & (F.col("rows._md5") == F.col("gone._md5"))
    return rows.join(gone, same, "left_anti").select(*unbundled(carry))
