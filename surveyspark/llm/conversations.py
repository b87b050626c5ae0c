"""Prefix trie of conversations: an adaptive radix tree for each range of sorted turn-id sequences, joined at the seams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .radix import RadixTree

WIDTH = 16  # bytes of a turn id
CHUNK = 1 << 20

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
PIECE = pa.schema([
    ("kind", pa.int8()), *((c, pa.int64()) for c in NODE[:-1]), ("ends_sha256", pa.string()),
    ("part", pa.int32()), ("seq", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("ends", pa.binary()),
])
PIECE_DDL = "kind tinyint, " + ", ".join(f"{c} long" for c in NODE[:-1]) + ", ends_sha256 string, part int, seq long, node binary, parent binary, n_bytes long, ends binary"
WHOLE, SEAM, ENDS = 0, 1, 2


def turn_sequences(df: DataFrame) -> DataFrame:
    """(base, conv_id, turns): the turns of each conversation in order, as structs of id and n_bytes.

    Turns go by number, null first; equal numbers by role, then by id. A turn's id is the first 16 bytes of the SHA-256
    of the role's length, role and text, in hexadecimal. Rows are dealt by ``base``, so conversations of one base meet.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ident = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = df.filter("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % 5).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), ident.alias("id"), F.octet_length(text).cast("long").alias("n_bytes")).alias("t"),
    )
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["n_bytes"].alias("n_bytes")))
    return rows.repartition("base").groupBy("base", "conv_id").agg(turns.alias("turns"))


def rebuilt(df: DataFrame) -> DataFrame:
    """(conv_id, turns): conversation c takes its first h turns from c - c % 5, where h is crc32(decimal c) % 9, and
    its later ones from itself. A base without rows gives none."""
    own = turn_sequences(df).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    base = own.filter("conv_id = base").select("base", F.slice("turns", 1, 8).alias("head"))
    empty = F.expr("filter(turns, t -> false)")
    return own.join(base, "base", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")
    )


class _Pieces:
    """Rows of one range: nodes that lie wholly in it, and what it knows of those that may reach beyond it."""

    def __init__(self, part: int, keys: list[bytes], convs: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
        self.part, self.keys, self.convs, self.sizes, self.starts = part, keys, convs, sizes, starts
        self.rows: list[tuple] = []

    def _prefixes(self, key: bytes) -> list[bytes]:
        """Names of all turn-aligned prefixes."""
        h, out = hashlib.sha256(), []
        for at in range(0, len(key) + 1, WIDTH):
            out.append(h.copy().digest()[:WIDTH])
            h.update(key[at:at + WIDTH])
        return out

    def _tree(self) -> RadixTree:
        tree, first = RadixTree(), 0
        for i in range(1, len(self.keys) + 1):
            if i == len(self.keys) or self.keys[i] != self.keys[first]:
                tree.insert(self.keys[first], (first, i - 1))  # rows of equal keys stand together
                first = i
        return tree

    def build(self) -> list[tuple]:
        last = len(self.keys) - 1
        names = {0: self._prefixes(self.keys[0]), last: self._prefixes(self.keys[last])}
        tree = self._tree()
        depth, low, high, least, ends, parent = [], [], [], [], [], []
        kids: list[list[int]] = []
        spans: dict[int, tuple[int, int, int, list[int]]] = {}
        for node, above, below in tree.upward():
            lo, hi, small, front = len(self.keys), -1, None, []
            for _, kid in node.children():
                a, b, m, f = spans.pop(id(kid))
                lo, hi, small = min(lo, a), max(hi, b), m if small is None else min(m, small)
                front = f + front if len(f) > len(front) else front + f
            if node.value is not None:
                a, b = node.value
                m = int(self.convs[a:b + 1].min())
                lo, hi, small = a, max(hi, b), m if small is None else min(m, small)
            top = 0 if node is tree.root else above // WIDTH + 1
            for d in range(below // WIDTH, top - 1, -1):
                me = len(depth)
                for i in front:
                    parent[i] = me
                depth.append(d), low.append(lo), high.append(hi), least.append(small), parent.append(-1), kids.append(front)
                ends.append(node.value if d * WIDTH == below else None)
                front = [me]
            spans[id(node)] = lo, hi, small, front
        seam = [a == 0 or b == last for a, b in zip(low, high)]
        leaves, saved = [0] * len(depth), [0] * len(depth)
        named = lambda i: names[0 if low[i] == 0 else last][depth[i]]
        for i, d in enumerate(depth):  # children come before their parents
            inner = [j for j in kids[i] if not seam[j]]
            leaves[i] = sum(leaves[j] for j in inner)
            saved[i] = sum(saved[j] for j in inner)
            size = int(self.sizes[self.starts[low[i]] + d - 1]) if d else 0
            n, up = high[i] - low[i] + 1, parent[i]
            ids = ",".join(map(str, self.convs[ends[i][0]:ends[i][1] + 1].tolist())) if ends[i] else ""
            if seam[i]:
                self.rows.append((SEAM, least[i], d, None, n, len(inner), leaves[i], saved[i], None, self.part, low[i], named(i), named(up) if up >= 0 else None, size, None))
                for at in range(0, len(ids), CHUNK):
                    self.rows.append((ENDS, None, d, None, None, None, None, None, None, self.part, at, named(i), None, None, ids[at:at + CHUNK].encode()))
                continue
            leaves[i] = leaves[i] or 1
            saved[i] += (n - 1) * size
            known = not seam[up]
            self.rows.append((WHOLE, least[i], d, least[up] if known else None, n, len(kids[i]), leaves[i], saved[i], hashlib.sha256(ids.encode()).hexdigest(), self.part, None, None, None if known else named(up), None, None))
        return self.rows


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 20_000):
        part = rows[i:i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [b for b in batches if b.num_rows]
    if table:
        keys = [k for b in table for k in b.column("key").to_pylist()]
        convs = np.concatenate([b.column("conv_id").to_numpy() for b in table])
        lists = pa.chunked_array([b.column("sizes") for b in table]).combine_chunks()
        sizes, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        yield from _batches(_Pieces(TaskContext.get().partitionId(), keys, convs, sizes, starts).build(), PIECE)


SEAMS = pa.schema([(c, pa.int64()) for c in NODE if c not in ("parent_conv_id", "ends_sha256")] + [("node", pa.binary()), ("parent", pa.binary())])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the nodes at the seams, ranges in order and each range from the root along its first and last key.

    The open path is all that is held: a node is closed when the order has left it, and then counts for its parent.
    """
    path: list[dict] = []
    out: list[tuple] = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            x = path.pop()
            leaves = x["n_leaves"] or 1  # a node with children has theirs
            saved = x["saved_tokens"] + (x["n_convs"] - 1) * x["n_bytes"]
            out.append((x["conv_id"], x["depth"], x["n_convs"], x["n_children"], leaves, saved, x["node"], x["parent"]))
            if path:
                up = path[-1]
                up["n_children"] += 1
                up["n_leaves"] += leaves
                up["saved_tokens"] += saved

    for b in batches:
        for x in b.to_pylist():
            d = x["depth"]
            if d < len(path) and path[d]["node"] == x["node"]:
                known = path[d]
                known["conv_id"] = min(known["conv_id"], x["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    known[c] += x[c]
            else:
                close(d)
                path.append(x)
        yield from _batches(out, SEAMS)
        out.clear()
    close(0)
    yield from _batches(out, SEAMS)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose chunks stream past in order."""
    node, part, h, rows = None, None, None, []
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        for n, p, chunk in zip(b.column("node").to_pylist(), b.column("part").to_pylist(), b.column("ends").to_pylist()):
            if n != node:
                if node is not None:
                    rows.append((node, h.hexdigest()))
                node, h = n, hashlib.sha256()
            elif p != part:
                h.update(b",")  # ranges meet between two ids, chunks of a range anywhere
            part = p
            h.update(chunk)
        yield from _batches(rows, schema)
        rows.clear()
    if node is not None:
        yield from _batches([(node, h.hexdigest())], schema)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has conv_id and turns (structs of a hexadecimal 16-byte id and n_bytes); each row is a member, rows
    that repeat an id too. Sequences are sorted by ranges of their joined ids and conv_id, so that copies of one
    sequence may lie in many ranges; each range builds its own radix tree. Nodes on the paths of a range's first and last key may reach
    into other ranges: their pieces (a path each, whatever the range holds) are put together in order by one task that
    holds one path. Other nodes are final. Ids of members that end at such a node are hashed from chunks that stream
    through one task, since a SHA-256 has an order. An empty table has no nodes, not even a root.
    """
    ids = F.transform("turns", lambda t: t["id"])
    keyed = written(sequences.select("conv_id", F.unhex(F.array_join(ids, "")).alias("key"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes")), "turn-sequences")
    pieces = written(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_range, PIECE_DDL), "trie-pieces")

    seam = pieces.filter(F.col("kind") == SEAM)
    ordered = seam.select(*SEAMS.names, "n_bytes", "part", "seq").repartition(1).sortWithinPartitions("part", "seq", "depth")
    ddl = ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in SEAMS)
    merged = written(ordered.mapInArrow(_seams, ddl), "trie-seams")

    chunks = pieces.filter(F.col("kind") == ENDS).select("node", "part", "seq", "ends")
    hashes = chunks.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(_hashes, "node binary, ends_sha256 string")
    ups = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    seams = merged.join(ups, "parent", "left").join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))

    whole = pieces.filter(F.col("kind") == WHOLE)
    # The upper end of a final node at a seam is looked up by range and name, so that no one name gathers all rows.
    there = seam.select("part", F.col("node").alias("parent")).distinct().join(ups, "parent")
    hung = whole.filter("parent IS NOT NULL").drop("parent_conv_id").join(there, ["part", "parent"])
    return whole.filter("parent IS NULL").select(*NODE).union(hung.select(*NODE)).union(seams.select(*NODE))


def conversation_trie(df: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of a table of conv_id, turn, role, text.

    Null role or text is empty, rows without a conv_id belong to no conversation, repeated rows are turns of their
    own, and equal turn numbers go by role, then by the turn's hash. Other columns are not read. The turn ids of one conversation (24 bytes a
    turn) meet in one task.
    """
    return prefix_trie(rebuilt(df.select("conv_id", "turn", "role", "text")))


def oracle_sql() -> str:
    return """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, substr(sha256(strlen(role) || ':' || role || text), 1, 32)) AS turns FROM t GROUP BY 1),
table_ AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs),
h AS (SELECT conv_id, turns, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, crcs[1 + (xor(a, b) & 255)]))) % 9 AS h FROM c, table_),
s AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(x.turns[1:h], []), h.turns[h + 1:]) AS s FROM h LEFT JOIN c x ON x.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS over FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM s)),
n AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d > 0 THEN strlen(k[d].t) ELSE 0 END AS saved FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k, d)),
below AS (SELECT k[1:e] AS k, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS e FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN below USING (k, d) LEFT JOIN n u ON u.d = m.d - 1 AND u.k = m.k[1:m.d - 1]
"""
