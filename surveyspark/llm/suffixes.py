"""Removal of repeated byte strings across documents: routed by content, decided by suffix sorting in shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _P, hashes, mix, slices, text_bytes
from .common import carried, named, release, schema_of, written
from .induced import classes

#: Bytes of the grams whose least hash stands for a window.
GRAM = 16
_HELD = 1_000_000
#: Bytes of text looked at together: their arrays stay in a core's caches.
_SLICE = 1 << 17
#: Bytes of blobs that are cut by key together.
_MERGED = 16 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    a, width, power = _BYTE[data], 1, _P
    while width < GRAM:
        next_ = a[:-width] * np.uint64(power)
        next_ += a[width:]
        a, power, width = next_, power * power % 2**64, 2 * width
    a ^= a >> np.uint64(32)
    a *= np.uint64(_P)
    a ^= a >> np.uint64(29)
    return a


def routed(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least gram: first window, number of windows, document, hash of the gram.

    A window of ``length`` bytes belongs to the gram with the least hash inside it. Equal windows have equal grams, so
    whatever shares a window meets under its gram's hash.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, np.empty(0, np.uint64)
    m, w, span = gram_hashes(data), 1, length - GRAM + 1
    while 2 * w <= span:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if span > w:
        m = np.minimum(m[:w - span], m[span - w:])
    valid = np.ones(len(m), bool)  # windows that would cross a document's end are none
    if len(off) < 2000:
        for e in off[1:-1].tolist():
            valid[max(0, e - length + 1):e] = False
    else:
        ends = np.zeros(len(data) + 1, np.int32)
        np.add.at(ends, np.maximum(off[1:-1] - length + 1, 0), 1)
        np.add.at(ends, off[1:-1], -1)
        valid = np.cumsum(ends)[:len(m)] == 0
    new = np.empty(len(m), bool)
    new[0] = True
    np.not_equal(m[1:], m[:-1], out=new[1:])
    new[1:] |= ~valid[:-1]
    new[off[:-1][off[:-1] < len(m)]] = True
    lo = np.flatnonzero(new & valid)
    if not len(lo):
        return none, none, none, np.empty(0, np.uint64)
    return lo, np.add.reduceat(valid, lo, dtype=np.int64), np.searchsorted(off, lo, "right") - 1, m[lo]


def spark_hash(d: np.ndarray) -> np.ndarray:
    """xxhash64 of longs as Spark computes it (seed 42)."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
    turn = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    h = np.full(len(d), (42 + 0x27D4EB2F165667C5 + 8) % 2**64, np.uint64) ^ turn(d.astype(np.uint64) * p[1], 31) * p[0]
    h = turn(h, 27) * p[0] + p[3]
    h = (h ^ h >> np.uint64(33)) * p[1]
    h = (h ^ h >> np.uint64(29)) * p[2]
    return (h ^ h >> np.uint64(32)).view(np.int64)


def _group(d: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(spark_hash(d), groups)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary; differences of 64-bit columns make most bytes zero."""
    import zstandard

    out = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        if a.dtype == np.int64:
            a = np.diff(a, prepend=0)
            a = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T)  # byte planes
        out.append(a.tobytes())
    return zstandard.ZstdCompressor(level=2).compress(b"".join(out))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, 1 + len(kinds))[1:].tolist()
    at, out = 8 * (1 + len(kinds)), []
    for n, kind in zip(sizes, kinds):
        size = n * np.dtype(kind).itemsize
        a = np.frombuffer(raw, np.uint8, size, at)
        at += size
        out.append(np.cumsum(np.ascontiguousarray(a.reshape(8, -1).T).view(np.int64).ravel()) if kind == np.int64 else a.view(kind))
    return out


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    cut = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(keys) else []
    for a, b in zip(cut, [*cut[1:], len(keys)]):
        yield int(sorted_[a]), order[a:b]


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "blob" else pa.int64()) for c, n in zip(cols, names)], names)


#: Columns of the blobs that travel, after the key: grams (document, hash, whether of several), hashes told to groups, contexts
#: (group, least id, how much larger the largest, size, bytes), decided runs of windows (context, smallest id, from, to).
_GRAM, _TOLD, _CONTEXT, _RUN = [np.int64, np.int64, np.uint8], [np.int64], [np.uint32, np.int64, np.int64, np.uint32, np.uint8], [np.int64, np.int64, np.uint32, np.uint32]


class Keys(NamedTuple):
    """Shards or groups: their number, and how many of them share a bucket.

    Tasks cut their output by bucket, and a bucket is cut by key where it arrives. Buckets are bounded in number, so that
    blobs grow with the bytes and not with groups times shards.
    """

    count: int
    fan: int


def _bucketed(key: np.ndarray, fan: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of arrays with one entry a key; the blob tells the keys of a bucket apart."""
    for bucket, i in _split(key // fan):
        yield bucket, _pack((key[i] % fan).astype(np.uint32), *[a[i] for a in arrays])


def _by_key(batches: Iterator[pa.RecordBatch], fan: int, kinds: list, ragged: bool) -> Iterator[pa.RecordBatch]:
    """Blobs of buckets cut into blobs of single keys; rows for a group pass. If ``ragged``, the last array holds as many
    bytes an entry as the array before it says."""
    held: list[list[np.ndarray]] = []
    passed: list[tuple] = []
    names: list[str] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = list(passed)
        if held:
            key, *cols = (np.concatenate(x) for x in zip(*held))
            if ragged:
                *cols, body = cols
                size = cols[-1].astype(np.int64)
                start = np.cumsum(size) - size
            for k, i in _split(key):
                part = [c[i] for c in cols] + ([_joined(body, start[i], size[i])[0]] if ragged else [])
                rows.append((k, *[-1] * (len(names) - 2), _pack(np.zeros(len(i), np.uint32), *part)))
        held.clear()
        passed.clear()
        yield _rows(rows, names)

    size = 0
    for b in batches:
        names = b.schema.names
        for r in b.to_pylist():
            if r.get("gb", -1) >= 0:
                passed.append((r["key"] * fan, r["gb"], r["blob"]))
                size += len(r["blob"])
            else:
                sub, *cols = _unpack(r["blob"], np.uint32, *kinds)
                held.append([r["key"] * fan + sub.astype(np.int64), *cols])
                size += sum(c.nbytes for c in held[-1])
            if size >= _MERGED:
                yield from flush()
                size = 0
    if size:
        yield from flush()


def _dealt(rows: DataFrame, fan: int, kinds: list, ragged: bool = False) -> DataFrame:
    """Rows of buckets as rows of keys, all rows of a key in one partition."""
    rows = rows.repartition("key")
    if fan > 1:
        rows = rows.sortWithinPartitions("key").mapInArrow(lambda it: _by_key(it, fan, kinds, ragged), rows.schema)
    return rows


def _grams(batches: Iterator[pa.RecordBatch], length: int, shards: Keys, groups: Keys) -> Iterator[pa.RecordBatch]:
    """Distinct (gram, document) pairs of some megabytes of text, by bucket of the gram's shard.

    Grams of several documents here are known to be shared: they go back to those documents' groups at once (rows with
    a bucket ``gb`` of groups) and stand in their shard with one entry, so a gram in every document costs one entry a batch.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h, d = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(h)
        h, d = h[order], d[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        least = np.minimum.reduceat(d, at)
        many = least != np.maximum.reduceat(d, at)
        shared = np.repeat(many, np.diff(np.append(at, len(h))))
        rows = [(g % -(-shards.count // shards.fan), g, blob) for g, blob in _told(d[shared], h[shared], groups)]
        h, d = h[at], least
        order = np.lexsort((h, d))
        h, d, many = h[order], d[order], many[order]
        n = np.uint64(shards.count)
        low = ((h // n) & np.uint64((1 << 48) - 1)).view(np.int64)  # 48 bits of the quotient are kept
        rows += [(s, -1, blob) for s, blob in _bucketed((h % n).astype(np.int64), shards.fan, d, low, many.astype(np.uint8))]
        yield _rows(rows, ["key", "gb", "blob"])

    size = 0
    for b in slices(batches, "text", _SLICE):
        data, off = text_bytes(b.column("text"))
        _, _, doc, h = routed(data, off, length)
        held.append((h, b.column("d").to_numpy()[doc]))
        size += len(h)
        if size >= _HELD:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def _runs_of_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key of a partition sorted by it."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != now:
                if rows:
                    yield now, rows
                now, rows = r[key], []
            rows.append(r)
    if rows:
        yield now, rows


def _told(d: np.ndarray, h: np.ndarray, groups: Keys) -> Iterator[tuple[int, bytes]]:
    """Distinct hashes for the groups of documents, by bucket of the group."""
    g = _group(d, groups.count)
    order = np.lexsort((h, g))
    g, h = g[order], h[order]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))[:len(g)]
    return _bucketed(g[new], groups.fan, h[new].view(np.int64))


def _shared(batches: Iterator[pa.RecordBatch], shards: Keys, groups: Keys) -> Iterator[pa.RecordBatch]:
    """Hashes of grams that two documents hold, for the groups of all documents that hold them."""
    for shard, rows in _runs_of_key(batches, "key"):
        out = [(r["gb"], r["blob"]) for r in rows if r["gb"] >= 0]
        parts = [_unpack(r["blob"], np.uint32, *_GRAM)[1:] for r in rows if r["gb"] < 0]
        if parts:
            d, h, many = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h)
            h, d, many = h[order], d[order], many[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            common = (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)) | (np.maximum.reduceat(many, at) > 0)
            keep = np.repeat(common, np.diff(np.append(at, len(h)))) & (many == 0)  # the others are told already
            out += _told(d[keep], h[keep].view(np.uint64) * np.uint64(shards.count) + np.uint64(shard), groups)
        yield _rows(out, ["key", "blob"])


def _short(h: np.ndarray, shards: Keys) -> np.ndarray:
    """A gram's hash as its shard knows it."""
    n = np.uint64(shards.count)
    return ((h // n) & np.uint64((1 << 48) - 1)) * n + h % n


def _texts(t: pa.Table) -> Iterator[pa.RecordBatch]:
    return slices(iter(t.combine_chunks().to_batches()), "text", _SLICE)


def _contexts(docs: pa.Table, info: pa.Table, length: int, shards: Keys) -> pa.Table:
    """Distinct contexts (all bytes of a run of windows) of shared grams in a group of documents, by bucket of the shard.

    Each goes with the least and the largest id of the documents here that hold it.
    """
    rows: list[tuple] = []
    if info.num_rows and docs.num_rows:
        known = np.concatenate([_unpack(x, np.uint32, *_TOLD)[1].view(np.uint64) for x in info.column("blob").to_pylist()])
        known = np.sort(_short(known, shards))
        code, body, size, least, most, shard = ([] for _ in range(6))
        for b in _texts(docs):
            data, off = text_bytes(b.column("text"))
            lo, n, doc, h = routed(data, off, length)
            h = _short(h, shards)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            use = known[at] == h
            lo, n, doc, h = lo[use], n[use], doc[use], h[use]
            d = b.column("d").to_numpy()[doc]
            c = hashes(data, lo, lo + n + length - 1)
            order = np.lexsort((d, c))
            first = np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1])) if len(c) else np.empty(0, np.int64)
            if len(first):
                i = order[first]
                code.append(c[i])
                least.append(d[i])
                most.append(np.maximum.reduceat(d[order], first))
                size.append(n[i] + length - 1)
                shard.append((h[i] % np.uint64(shards.count)).astype(np.int64))
                raw = data.tobytes()
                body += [raw[a:e] for a, e in zip(lo[i].tolist(), (lo + n + length - 1)[i].tolist())]
        if code:
            code, size, least, most, shard = (np.concatenate(x) for x in (code, size, least, most, shard))
            order = np.lexsort((least, code))
            first = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
            most, i = np.maximum.reduceat(most[order], first), order[first]
            fan, grp = shards.fan, docs.column("grp")[0].as_py()
            for bucket, j in _split(shard[i] // fan):
                j = j[np.argsort(least[i[j]], kind="stable")]
                k = i[j]
                rows.append((bucket, _pack((shard[k] % fan).astype(np.uint32), np.full(len(k), grp, np.uint32), least[k], most[j] - least[k], size[k].astype(np.uint32), np.frombuffer(b"".join([body[x] for x in k.tolist()]), np.uint8))))
    return pa.Table.from_batches([_rows(rows, ["key", "blob"])])


def _joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges one after another, and where each begins."""
    at = np.cumsum(size) - size
    return data[np.repeat(start - at, size) + np.arange(size.sum())], at


def _windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of each window and its place there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _twins(text: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Contexts one of whose windows has the hash of another window; equal windows have equal hashes."""
    w, inside = _windows(n)
    h = hashes(text, at[w] + inside, at[w] + inside + length)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(n), bool)
    out[w[order[1:][same]]] = out[w[order[:-1][same]]] = True
    return out


def _decide(batches: Iterator[pa.RecordBatch], length: int, groups: Keys) -> Iterator[pa.RecordBatch]:
    """For each context of a shard, runs of windows and the smallest document that holds each of them, by bucket of the group.

    A gram with one context needs no sorting: all its windows are in all its documents. Nor does a context whose windows
    all have hashes of their own. The others are suffix-sorted together; windows that share their first ``length`` bytes
    are neighbours in that order.
    """
    for _, rows in _runs_of_key(batches, "key"):
        parts = [_unpack(r["blob"], np.uint32, *_CONTEXT)[1:] for r in rows]
        grp, least, more, size, data = (np.concatenate(x) for x in zip(*parts))
        grp, size, most = grp.astype(np.int64), size.astype(np.int64), least + more
        start = np.cumsum(size) - size
        code = hashes(data, start, start + size)
        order = np.argsort(code)
        new = np.append(True, code[order][1:] != code[order][:-1])
        of = np.empty(len(code), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]  # one entry of each distinct context
        low = np.minimum.reduceat(least[order], np.flatnonzero(new))
        gram = np.zeros(len(first), np.uint64)
        for i in range(0, len(first), 50_000):  # the least gram of the first window is the least of all
            j = first[i:i + 50_000]
            head, _ = _joined(data, start[j], np.full(len(j), length))
            gram[i:i + 50_000] = gram_hashes(head)[(np.arange(len(j)) * length)[:, None] + np.arange(length - GRAM + 1)].min(1)
        _, gram_of, held = np.unique(gram, return_inverse=True, return_counts=True)
        alone = held[gram_of] == 1
        n = size[first] - length + 1
        if not alone.all():
            many = np.flatnonzero(~alone)
            alone[many] = ~_twins(*_joined(data, start[first[many]], size[first[many]]), n[many], length)
        ctx, lo, hi, who = [np.flatnonzero(alone)], [np.zeros(int(alone.sum()), np.int64)], [n[alone]], [low[alone]]
        if not alone.all():
            many = np.flatnonzero(~alone)
            text, text_at = _joined(data, start[first[many]], size[first[many]])
            w, inside = _windows(n[many])
            kind = classes(text, text_at[w] + inside, length)
            best = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, kind, low[many][w])
            found = best[kind]
            cut = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (found[1:] != found[:-1])))
            ctx.append(many[w[cut]])
            lo.append(inside[cut])
            hi.append(inside[np.append(cut[1:], len(w)) - 1] + 1)
            who.append(found[cut])
        ctx, lo, hi, who = (np.concatenate(x) for x in (ctx, lo, hi, who))
        order = np.argsort(ctx, kind="stable")
        ctx, lo, hi, who = ctx[order], lo[order], hi[order], who[order]
        ptr = np.searchsorted(ctx, np.arange(len(first) + 1))
        runs = np.diff(ptr)[of]  # every entry gets the runs of its context
        entry = np.repeat(np.arange(len(code)), runs)
        run = np.repeat(ptr[of] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        use = who[run] < most[entry]
        entry, run = entry[use], run[use]
        order = np.lexsort((code[entry], grp[entry]))
        entry, run = entry[order], run[order]
        out = list(_bucketed(grp[entry], groups.fan, code[entry].view(np.int64), who[run], lo[run].astype(np.uint32), hi[run].astype(np.uint32)))
        yield _rows(out, ["key", "blob"])


def _cut(docs: pa.Table, info: pa.Table, length: int, keep: list[str], as_text: str | None) -> Iterator[pa.RecordBatch]:
    """The documents of a group without what their contexts' runs name a smaller document for."""
    blobs = [_unpack(x, np.uint32, *_RUN)[1:] for x in (info.column("blob").to_pylist() if info.num_rows else [])]
    if blobs:
        code, who, run_lo, run_hi = (np.concatenate(x) for x in zip(*blobs))
        order = np.argsort(code.view(np.uint64), kind="stable")
        code, who, run_lo, run_hi = code.view(np.uint64)[order], who[order], run_lo[order].astype(np.int64), run_hi[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
        each, code = np.diff(np.append(first, len(code))), code[first]
    for b in _texts(docs):
        data, off = text_bytes(b.column("text"))
        gone = np.zeros(len(data), bool)
        if blobs and len(code):
            lo, n, doc, _ = routed(data, off, length)
            c = hashes(data, lo, lo + n + length - 1)
            at = np.minimum(np.searchsorted(code, c), len(code) - 1)
            place = np.flatnonzero(code[at] == c)
            hits, a = each[at[place]], first[at[place]]
            run = np.repeat(a - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
            place = np.repeat(place, hits)
            use = who[run] < b.column("d").to_numpy()[doc[place]]
            place, run = place[use], run[use]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, lo[place] + run_lo[run], np.int32(1))
            np.add.at(edge, lo[place] + run_hi[run] + length - 1, np.int32(-1))
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        rises = gone & ~np.append(False, gone[:-1])
        rises[off[:-1][off[:-1] < len(data)]] = gone[off[:-1][off[:-1] < len(data)]]
        count = lambda x: np.diff(np.searchsorted(np.flatnonzero(x), off))
        raw = data[~gone].tobytes()
        taken = count(gone)
        ends = (off - np.append(0, np.cumsum(taken))).tolist()
        rest = [raw[i:j] for i, j in zip(ends[:-1], ends[1:])]
        out = {c: b.column(c) for c in keep}
        if as_text is not None:
            empty = b.column("text").is_null().to_pylist()
            out[as_text] = pa.array([None if x else r.decode("utf-8", "ignore") for r, x in zip(rest, empty)], pa.string())
        out |= {
            "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(taken), "n_spans": pa.array(count(rises)),
            "kept_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string()),
        }
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_text: str | None = None, shard_bytes: int = 4 << 20, group_bytes: int = 4 << 20, buckets: int = 256) -> DataFrame:
    """Columns ``carry`` of every row (the id by default), n_bytes, n_removed, n_spans, kept_sha256 and, named by ``as_text``, the rest.

    Every byte goes that lies in a ``length``-byte string which also starts in a document with a smaller id; strings are
    judged on the input and never cross documents.

    1. Each window belongs to its least 16-byte gram, so equal windows meet under one hash. Grams held by two documents are
       found by shards of the hash; each map task sends a gram at most once, however many of its documents hold it.
    2. Their contexts (the bytes of the windows) go to their shard, equal ones of a group of documents once, with the
       least and largest id. Of disputed grams, a shard sorts the suffixes of the contexts with a window whose hash occurs
       again, by external induced sorting (``induced``): tuples of position and common prefix pass through queues that spill to disk; windows whose common
       prefix reaches ``length`` are one class, and its least id decides.
    3. Documents re-make their contexts, look up the runs decided for them and drop the bytes.

    Work and tables grow with the bytes, since a task cuts its output for at most ``buckets`` (``Keys``); groups, shards and batches are bounded, and no document but the longest sets a
    task's memory. Hashes of contexts have 64 bits: two different contexts of one hash would be taken for equal.
    Null text counts as empty (its rest stays null). Rows that repeat an id never count as smaller than one another; a
    null id counts as larger than all. In ``as_text`` a character that lost part of its bytes is dropped. Of a
    carried column named like a new one, the new one stays. No rows give no rows.
    """
    spark = docs.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([as_text] if as_text is not None else [])]
    keep = carried([id_col] if carry is None else carry, new)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards, groups = (Keys(n, -(-n // buckets)) for n in (size // shard_bytes + 1, size // group_bytes + 1))
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    extra = [c.alias(f"_{i}") for i, c in enumerate(named(keep))]
    rows = docs.select(d.alias("d"), F.pmod(F.xxhash64(d), F.lit(groups.count)).alias("grp"), F.col(text_col).alias("text"), *extra)
    plain = rows.select("d", "grp", "text")

    def to_groups(rows: DataFrame, kinds: list) -> DataFrame:
        """Rows for buckets of groups as rows for groups; what joins them moves them again."""
        return (_dealt(rows, groups.fan, kinds) if groups.fan > 1 else rows).select(F.col("key").alias("grp"), "blob")

    grams = plain.select("d", "text").mapInArrow(lambda it: _grams(it, length, shards, groups), "key long, gb long, blob binary")
    grams = _dealt(grams, shards.fan, _GRAM).sortWithinPartitions("key")
    info = to_groups(grams.mapInArrow(lambda it: _shared(it, shards, groups), "key long, blob binary"), _TOLD)
    contexts = plain.groupBy("grp").cogroup(info.groupBy("grp")).applyInArrow(lambda a, b: _contexts(a, b, length, shards), "key long, blob binary")
    contexts = _dealt(contexts, shards.fan, _CONTEXT, ragged=True).sortWithinPartitions("key")
    decided = contexts.mapInArrow(lambda it: _decide(it, length, groups), "key long, blob binary")
    decided = written(to_groups(decided, _RUN), "decided")
    release(spark)

    made = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = [f"_{i}" for i in range(len(keep))]
    kind = schema_of(rows, names, (f"_text string, " if as_text is not None else "") + made)

    def finish(a: pa.Table, b: pa.Table) -> pa.Table:
        out = list(_cut(a, b, length, names, None if as_text is None else "_text")) if a.num_rows else []
        if not out:
            from pyspark.sql.pandas.types import to_arrow_schema

            return to_arrow_schema(kind).empty_table()
        return pa.Table.from_batches(out)

    done = rows.groupBy("grp").cogroup(decided.groupBy("grp")).applyInArrow(finish, kind)
    return done.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], *([F.col("_text").alias(as_text)] if as_text is not None else []),
        "n_bytes", "n_removed", "n_spans", "kept_sha256",
    )
