"""SentencePiece merge encoding with seeded merge dropout, and decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesets import hashes, mix, slices
from .common import carried, named, schema_of

#: Merges never cross into the next of these stretches: no piece has a space behind another character or a line feed.
_STRETCH = re.compile(r" *[^ \n]+| +|\n")
_NEVER = np.int64(1 << 62)


def _slot(key: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)


def _table(entries: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.uint64, int]:
    """Open-addressed table of keys and values, for whole arrays of lookups."""
    bits = 20
    while len(entries) > 1 << bits - 2:
        bits += 1
    shift, slots = np.uint64(64 - bits), 1 << bits
    keys, values = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
    left, value = np.array(list(entries), np.int64), np.array(list(entries.values()), np.int64)
    at = _slot(left, shift)
    while len(left):
        free = keys[at] == -1
        keys[at[free]], values[at[free]] = left[free], value[free]  # of several, the last stays
        rest = keys[at] != left
        left, value, at = left[rest], value[rest], (at[rest] + 1) % slots
    return keys, values, shift, slots


def _lookup(table: tuple[np.ndarray, np.ndarray, np.uint64, int], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each key, and whether the table has it."""
    keys, values, shift, slots = table
    slot = _slot(key, shift)
    found = keys[slot]
    other = np.nonzero((found != key) & (found != -1))
    while len(other[0]):
        slot[other] = (slot[other] + 1) % slots
        now = keys[slot[other]]
        go_on = (now != key[other]) & (now != -1)
        other = tuple(x[go_on] for x in other)
    return values[slot], keys[slot] == key


def _room(a: np.ndarray, size: int) -> np.ndarray:
    """The array, made longer if it has no room for ``size`` entries."""
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, len(a) * 3 // 2) - len(a), a.dtype)])


class _Decisions:
    """Trees of the decisions that lead from a stretch to its segmentation.

    A node holds the hash of the candidate at the top of the agenda and has two edges, for merging and for skipping it. A
    stretch's root is a node too, whose first edge leads to the first decision. An edge leads to a node, to a leaf
    (-1 - its number) or nowhere yet (0, which no edge leads to, as node 0 is unused). Leaves list the ids of segmentations.
    """

    def __init__(self):
        self.nodes, self.leaves, self.size = 1, 0, 0
        self.seen = np.zeros(1 << 16, np.uint64)
        self.to = np.zeros(1 << 17, np.int32)
        self.flat, self.start, self.word = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.roots = _Numbers()
        self.root = np.zeros(1 << 16, np.int32)

    def _more(self, n: int) -> np.ndarray:
        """Numbers of new nodes."""
        self.nodes += n
        self.seen, self.to = _room(self.seen, self.nodes), _room(self.to, 2 * self.nodes)
        return np.arange(self.nodes - n, self.nodes)

    def roots_of(self, words: list[str]) -> np.ndarray:
        """First edge of each stretch."""
        had = len(self.roots)
        number = np.fromiter(map(self.roots.__getitem__, words), np.int64, len(words))
        self.root = _room(self.root, len(self.roots))
        self.root[had:len(self.roots)] = self._more(len(self.roots) - had)
        return 2 * self.root[number].astype(np.int64)

    def descend(self, rows: np.ndarray, edge: np.ndarray, depth: np.ndarray, draw: np.ndarray, skip_below: np.uint64, out: np.ndarray) -> np.ndarray:
        """Follows the decisions of some rows from their edges on; gives the rows whose edge leads nowhere yet."""
        open_, at, key, steps = [], edge[rows], draw[rows], 0
        while len(rows):
            to = self.to[at]
            inner = to > 0
            if not inner.all():
                leaf, lost = to < 0, to == 0
                out[rows[leaf]] = -1 - to[leaf]
                r = rows[lost]
                edge[r] = at[lost]
                depth[r] += steps
                open_.append(r)
                rows, to, key = rows[inner], to[inner], key[inner]
            at = 2 * to.astype(np.int64) + (mix(key ^ self.seen[to]) < skip_below)
            steps += 1
        return np.concatenate(open_) if open_ else rows

    def grow(self, edge: np.ndarray, depth: np.ndarray, words: list[str], traced: tuple[np.ndarray, ...]) -> None:
        """Puts the rest of each trace behind its edge, which is ``depth`` decisions below the root."""
        ids, sizes, seen, skip, taken = traced
        rest = np.arange(len(seen)) - np.repeat(np.cumsum(taken) - taken, taken) >= np.repeat(depth, taken)
        seen, skip, n = seen[rest], skip[rest], taken - depth
        node = self._more(len(seen))
        self.seen[node] = seen
        some, ends = n > 0, np.cumsum(n)
        into = np.empty(len(node), np.int64)
        into[1:] = 2 * node[:-1] + skip[:-1]
        into[(ends - n)[some]] = edge[some]
        self.to[into] = node
        last = edge.copy()
        last[some] = 2 * node[ends[some] - 1] + skip[ends[some] - 1]
        first, self.leaves = self.leaves, self.leaves + len(edge)
        self.to[last] = -1 - np.arange(first, self.leaves)
        self.word = _room(self.word, self.leaves)
        self.word[first:self.leaves] = [self.roots[w] for w in words]
        self.start = _room(self.start, self.leaves + 1)
        self.start[first + 1:self.leaves + 1] = self.size + np.cumsum(sizes)
        self.flat = _room(self.flat, self.size + len(ids))
        self.flat[self.size:self.size + len(ids)] = ids
        self.size += len(ids)

    def ids(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some leaves one after the other, and how many each has."""
        start = self.start[leaf]
        n = self.start[leaf + 1] - start
        return self.flat[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)], n


class _Numbers(dict):
    """Numbers strings as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class MergeEncoder:
    """Merge-type segmentation of a SentencePiece vocabulary; candidates are skipped by keyed hash.

    A stretch starts as single characters. Its agenda holds every pair of neighbours that forms a piece; the best piece
    (highest score, leftmost first) is merged until none is left. A candidate is skipped when the hash of (seed,
    document, number of the stretch, place, piece) falls below ``dropout``: it leaves the agenda, and only another merge
    beside it can bring a new candidate. Characters without a piece become their bytes, so decoding loses nothing.

    Every occurrence draws for itself. Its segmentation depends on nothing but the stretch and whether each candidate that
    comes to the top of the agenda is skipped. These decisions form a tree for each stretch, kept in arrays of bounded size:
    all occurrences go down their trees side by side, and the agenda runs only where a branch has not been seen yet.
    ``keep_mark``: U+2581 of a text becomes its bytes; by default it is a space, as the library has it.
    """

    def __init__(self, name: str, dropout: float, seed: int, limit: int = 400_000, wide: int = 40, keep_mark: bool = False):
        import public_tokenizers
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.seed, self.limit, self.wide, self.keep_mark = seed, limit, wide, keep_mark
        self.skip_below = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        by_score = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.zeros(size + 1, np.int64)
        self.rank[by_score] = np.arange(len(by_score))
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.none = size  # stands for a character without a piece
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = _table(pairs)
        made = set(pairs.values())
        self.merged = {p: i for p, i in self.ids.items() if i in made}
        self.of_char = np.full(0x110000, size, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")] = self.of_char[0x2581]
        if keep_mark:
            self.of_char[0x2581] = size
        self.tree = _Decisions()

    @property
    def known(self) -> dict[tuple[str, int], bytes]:
        """Segmentations found so far, by stretch and number."""
        words, t = list(self.tree.roots), self.tree
        return {(words[t.word[i]], i): t.ids(np.array([i]))[0].tobytes() for i in range(t.leaves)}

    @cached_property
    def _prefixes(self) -> tuple[tuple[np.ndarray, np.ndarray, np.uint64, int], np.ndarray]:
        """A tree of the merged pieces: the table leads from a node and a character to the next node, if any; and each node's piece."""
        nodes: dict[int, int] = {}
        piece_at = {}
        for text, i in self.merged.items():
            node = 0
            for c in text:
                node = nodes.setdefault(node << 21 | ord(c), len(nodes) + 1)
            piece_at[node] = i
        pieces = np.full(len(nodes) + 1, -1, np.int64)
        pieces[list(piece_at)] = list(piece_at.values())
        return _table(nodes), pieces

    def _candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece and agenda order of neighbours; the order is _NEVER where there is no piece or the key skips it."""
        piece, ok = _lookup(self.pairs, left << 32 | right)
        if self.skip_below and key is not None:
            ok &= mix(key ^ mix((at << 20 | piece).astype(np.uint64))) >= self.skip_below
        return piece, np.where(ok, self.rank[piece] << 32 | at, _NEVER)

    def _possible(self, words: list[str]) -> list[np.ndarray | None]:
        """Of each stretch all candidates (place and piece) that any order of merges can bring, or None if they are too many
        for a mask. All places of all stretches walk the tree of pieces side by side."""
        short = [w for w in words if len(w) <= self.wide]
        length = np.array([len(w) for w in short], np.int64)
        start = np.cumsum(length) - length
        text = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if self.keep_mark:
            text = np.where(text == 0x2581, 0, text)
        text[text == 0x20] = 0x2581
        steps, piece_at = self._prefixes
        word = np.repeat(np.arange(len(short)), length)
        at, node, end, depth, found = np.arange(len(text)), np.zeros(len(text), np.int64), (start + length)[word], 0, []
        while len(at):
            node, ok = _lookup(steps, node << 21 | text[at + depth])
            depth += 1
            at, node, end = at[ok], node[ok], end[ok]
            piece = piece_at[node]
            full = piece >= 0
            found.append((at[full], piece[full]))
            more = at + depth < end
            at, node, end = at[more], node[more], end[more]
        places, pieces = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))
        order = np.argsort(places, kind="stable")
        places, pieces = places[order], pieces[order]
        of = word[places]
        made = mix(((places - start[of]) << 20 | pieces).astype(np.uint64))
        ends = np.searchsorted(of, np.arange(len(short)), "right").tolist()
        parts = iter([made[a:z] if z - a <= 64 else None for a, z in zip([0, *ends[:-1]], ends)])
        return [next(parts) if len(w) <= self.wide else None for w in words]

    def _traced(self, words: list[str], keys: np.ndarray | int) -> tuple[np.ndarray, ...]:
        """Agendas of many short stretches side by side: each round takes the best candidate of every stretch.

        One row a stretch, one column a character; a merged symbol stays in its first column, ``after`` and ``before``
        link the columns in use, and ``order`` holds the candidate that starts in each. Gives the ids of all stretches
        and how many each has, then the hashes of the candidates that came to the top, whether they were skipped, and
        how many each stretch had.
        """
        n, length = len(words), np.fromiter(map(len, words), np.int64, len(words))
        wide = int(length.max())
        sym = np.full((n, wide + 1), self.none, np.int64)
        sym[np.arange(wide + 1) < length[:, None]] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        cols = np.broadcast_to(np.arange(wide + 1, dtype=np.int64), (n, wide + 1))
        after, before = cols + 1, cols - 1
        alive = cols < length[:, None]
        key = np.broadcast_to(np.asarray(keys, np.uint64), n)
        piece, order = self._candidates(sym[:, :-1], sym[:, 1:], cols[:, :-1])
        rows, taken = np.arange(n), []
        while len(rows):
            part = order if len(rows) == n else order[rows]
            best = part.argmin(1)
            ready = part[np.arange(len(rows)), best] < _NEVER
            rows, best = rows[ready], best[ready]
            seen = mix((best << 20 | piece[rows, best]).astype(np.uint64))
            skip = mix(key[rows] ^ seen) < self.skip_below
            taken.append((rows, seen, skip))
            order[rows[skip], best[skip]] = _NEVER
            r, c = rows[~skip], best[~skip]
            gone = after[r, c]
            sym[r, c] = piece[r, c]
            alive[r, gone] = False
            inside = gone < wide
            order[r[inside], gone[inside]] = _NEVER
            then = after[r, gone]
            after[r, c] = then
            more = then <= wide
            before[r[more], then[more]] = c[more]
            for left, right in ((before[r, c], c), (c, then)):  # only the merged symbol's neighbours have new candidates
                ok = (left >= 0) & (right < length[r])
                i, s, t = r[ok], left[ok], right[ok]
                piece[i, s], order[i, s] = self._candidates(sym[i, s], sym[i, t], s)
            end = then >= length[r]
            order[r[end], c[end]] = _NEVER
        sizes, ids = alive.sum(1), sym[alive].astype("<u4")
        odd = np.flatnonzero((alive & (sym == self.none)).any(1))
        if len(odd):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in odd.tolist():
                at = np.flatnonzero(alive[i])
                parts[i] = np.frombuffer(self._bytes(sym[i, at].tolist(), at.tolist(), words[i]), "<u4")
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        row, seen, skip = (np.concatenate([t[i] for t in taken]) for i in range(3))
        by = np.argsort(row, kind="stable")
        return ids, sizes, seen[by], skip[by], np.bincount(row, minlength=n)

    def _together(self, words: list[str], keys: np.ndarray | int) -> list[bytes]:
        ids, sizes = self._traced(words, keys)[:2]
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    def _alone(self, word: str, key: int) -> bytes:
        """The agenda of one stretch as a heap over linked symbols, for long ones."""
        sym = [int(self.of_char[ord(c)]) for c in word]
        n, key, heap = len(sym), np.array([key], np.uint64), []
        right, left, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n

        def push(at: np.ndarray, after: np.ndarray) -> None:
            a, b = np.array([sym[i] for i in at], np.int64), np.array([sym[i] for i in after], np.int64)
            piece, order = self._candidates(a, b, np.asarray(at, np.int64), key)
            for i in np.flatnonzero(order < _NEVER).tolist():
                heapq.heappush(heap, (int(order[i]), at[i], after[i], int(a[i]), int(b[i]), int(piece[i])))

        push(list(range(n - 1)), list(range(1, n)))
        while heap:
            _, i, j, a, b, piece = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and right[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], alive[j], right[i] = piece, False, right[j]
            if right[i] < n:
                left[right[i]] = i
            sides = [(x, y) for x, y in ((left[i], i), (i, right[i])) if x >= 0 and y < n]
            if sides:
                push([x for x, _ in sides], [y for _, y in sides])
        at = [i for i in range(n) if alive[i]]
        return self._bytes([sym[i] for i in at], at, word)

    def _bytes(self, symbols: list[int], at: list[int], word: str) -> bytes:
        if self.none in symbols:
            out = []
            for s, a in zip(symbols, at):
                out += [s] if s != self.none else [self.bytes[b] for b in word[a].encode()]
            symbols = out
        return np.array(symbols, "<u4").tobytes()

    def _segment(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """Segmentation of each stretch with the skips of its key."""
        long = [len(w) > self.wide for w in words]
        short = [w for w, x in zip(words, long) if not x]
        found = iter(self._together(short, keys[~np.array(long)]) if short else [])
        return [self._alone(w, int(k)) if x else next(found) for w, k, x in zip(words, keys, long)]

    def _leaves(self, words: list[str], draw: np.ndarray) -> np.ndarray:
        """Number of each short stretch's segmentation in the tree, which learns those it lacks."""
        tree = self.tree
        edge, out = tree.roots_of(words), np.empty(len(words), np.int64)
        depth = np.zeros(len(words), np.int64)
        todo = np.arange(len(words))
        while len(todo):
            todo = np.concatenate([tree.descend(todo[a:a + 20_000], edge, depth, draw, self.skip_below, out) for a in range(0, len(todo), 20_000)])
            new = todo[np.unique(edge[todo], return_index=True)[1]]  # one stretch for each branch not seen yet
            size = np.fromiter((len(words[i]) for i in new.tolist()), np.int64, len(new))
            new = new[np.argsort(size, kind="stable")]
            for a in range(0, len(new), 4000):
                part = new[a:a + 4000]
                some = [words[i] for i in part.tolist()]
                tree.grow(edge[part], depth[part], some, self._traced(some, draw[part]))
        return out

    def encode(self, texts: Iterable[str], keys: Iterable[int]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; its key and the stretch's number decide the skips of each stretch."""
        words: list[str] = []
        counts, own = [], []
        for text, key in zip(texts, keys):
            found = _STRETCH.findall(" " + (text if self.keep_mark else text.replace("▁", " "))) if text else []
            words += found
            counts.append(len(found))
            own.append(mix(np.arange(len(found), dtype=np.uint64) + mix(np.array([(key ^ self.seed * 0x9E3779B97F4A7C15) & 2**64 - 1], np.uint64))))
        if not words:
            return [b""] * len(counts)
        draw = mix(np.concatenate(own))
        if self.tree.leaves > self.limit:
            self.tree = _Decisions()
        size = np.fromiter(map(len, words), np.int64, len(words))
        long, sizes = np.flatnonzero(size > self.wide), np.zeros(len(words), np.int64)
        short = np.flatnonzero(size <= self.wide)
        flat, sizes[short] = self.tree.ids(self._leaves([words[i] for i in short.tolist()] if len(long) else words, draw[short]))
        if self.skip_below:
            alone = [self._alone(words[i], int(draw[i])) for i in long.tolist()]
        else:
            same = {w: self._alone(w, 0) for w in {words[i] for i in long.tolist()}}
            alone = [same[words[i]] for i in long.tolist()]
        ends = np.cumsum(sizes)
        raw, cuts = flat.tobytes(), [0, *np.append(0, 4 * ends)[np.cumsum(counts)].tolist()]
        if not alone:
            return [raw[a:e] for a, e in zip(cuts, cuts[1:])]
        out, at, of = [], 4 * ends[long], np.searchsorted(np.cumsum(counts), long, "right")
        starts = np.searchsorted(of, np.arange(len(counts) + 1)).tolist()
        for d, (a, e) in enumerate(zip(cuts, cuts[1:])):
            parts = []
            for i in range(starts[d], starts[d + 1]):
                parts += [raw[a:at[i]], alone[i]]
                a = int(at[i])
            out.append(b"".join([*parts, raw[a:e]]))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1) if ids else []


def encoder(name: str, dropout: float, seed: int) -> MergeEncoder:
    """The worker's encoder; like tokens.encoder it outlives the task on an installed module."""
    import sentencepiece

    kept = sentencepiece.__dict__.setdefault("_kept_mergers", {})
    if (name, dropout, seed) not in kept:
        kept[name, dropout, seed] = MergeEncoder(name, dropout, seed, keep_mark=True)
    return kept[name, dropout, seed]


def _encode(batches: Iterator[pa.RecordBatch], keep: list[str], id_col: str, text: str, name: str, dropout: float, seed: int, verify: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text, 1 << 20):
        keys = [hash(k) if isinstance(k, int) else zlib.crc32(str(k).encode()) for k in b.column(id_col).to_pylist()]
        coder, texts = encoder(name, dropout, seed), [t or "" for t in b.column(text).to_pylist()]
        ids = coder.encode(texts, keys)
        out = [b.column(c) for c in keep] + [pa.array(ids, pa.binary())]
        if verify:
            out.append(pa.array([a == t for a, t in zip(coder.decode(ids), texts)], pa.bool_()))
        yield pa.RecordBatch.from_arrays(out, [*keep, "ids"] + ["lossless"] * verify)


def encode_pieces(docs: DataFrame, name: str = "piece_bpe_32k.model", dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, verify: bool = False) -> DataFrame:
    """Columns ``carry`` of every row (all but the text by default) with ``ids``, little-endian unsigned 32-bit binary.

    ``verify`` decodes the ids in the same pass and adds ``lossless``, whether they give the text again.

    One pass, no shuffle; the same seed gives the same ids wherever and however often a task runs, another seed other
    segmentations. Null and empty texts have no ids. U+2581, by which the vocabulary writes the space, is encoded by its
    bytes. Rows repeating an id and text get equal ids. Of a carried column named ids or lossless, the new one stays. No
    rows give no rows.
    """
    keep = carried([c for c in docs.columns if c != text_col] if carry is None else carry, ["ids", "lossless"])
    kind = schema_of(docs, keep, "ids binary" + ", lossless boolean" * verify)
    read = list(dict.fromkeys([*keep, id_col, text_col]))
    return docs.select(*named(read)).mapInArrow(lambda it: _encode(it, keep, id_col, text_col, name, dropout, seed, verify), kind)


def decode_pieces(rows: DataFrame, name: str = "piece_bpe_32k.model", ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give null."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ids_col):
            ids = b.column(ids_col).to_pylist()
            found = iter(encoder(name, 0.0, 0).decode([x for x in ids if x is not None]))
            yield b.append_column(into, pa.array([None if x is None else next(found) for x in ids], pa.string()))

    return rows.mapInArrow(texts, schema_of(rows, rows.columns, f"{into} string"))
