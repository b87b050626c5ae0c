"""Induced suffix sorting of a byte string to a bounded depth, with common-prefix values.

The order of the leftmost S-type suffixes (LMS) comes first; L-type suffixes are induced from them bucket by bucket
upwards, S-type ones from the L-type downwards. Each first byte has a queue of (position, common prefix with the entry
before) tuples in the order of their induction, which is their sorted order; a queue beyond its share of memory goes to a
file. Whole batches of a bucket move at a time.
"""

from __future__ import annotations

import tempfile

import numpy as np

_WORD = 8


class DiskQueue:
    """Tuples (position, prefix) in order; what exceeds ``limit`` bytes lies in an unlinked file of the task."""

    def __init__(self, limit: int):
        self.limit, self.blocks, self.held, self.file, self.saved = limit, [], 0, None, []
        self.pushed = 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.pushed += len(pos)
        self.blocks.append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for p, c in self.blocks:
                self.saved.append(len(p))
                self.file.write(p.tobytes() + c.tobytes())
            self.blocks, self.held = [], 0

    def pull(self) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples so far; the queue is empty afterwards."""
        blocks = self.blocks
        if self.saved:
            self.file.seek(0)
            old = [(np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)) for n in self.saved]
            self.file.close()
            self.file, self.saved, blocks = None, [], old + blocks
        self.blocks, self.held = [], 0
        if not blocks:
            return None
        return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


class InducedSorter:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 64 << 20):
        self.n, self.depth = len(text) + 1, depth  # one byte more, so that the last suffix is L-type
        self.text = np.concatenate([text, [np.uint8(1)], np.zeros(depth + 2 * _WORD, np.uint8)])
        self.share = memory // 256
        n, t = self.n, self.text
        # S where the next different byte is larger
        changes = t[:-1] != t[1:]
        differs = np.flatnonzero(changes)
        at = np.cumsum(changes)[:n] - changes[:n]
        self.small = t[differs[at]] < t[differs[at] + 1]
        wide = np.lib.stride_tricks.sliding_window_view(self.text, _WORD)
        self.words = np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes, up to the depth."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        for step in range(0, self.depth, _WORD):
            x = self.words[a[open_] + step] ^ self.words[b[open_] + step]
            same = x == 0
            lead = np.zeros(len(x), np.int64)
            for k in range(1, _WORD):
                lead += x < np.uint64(1 << (64 - 8 * k))
            out[open_] = step + np.where(same, _WORD, lead)
            open_ = open_[same]
        return np.minimum(out, self.depth).astype(np.uint8)

    def _starts(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order and their prefixes with the one before."""
        pos = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        pos = pos[np.argsort(self.words[pos])]
        group = np.cumsum(np.append(False, self.words[pos[1:]] != self.words[pos[:-1]])[:len(pos)])
        tied = np.arange(len(pos))
        for step in range(_WORD, self.depth + _WORD, _WORD):  # only what is still tied is told apart by its next bytes
            g = group[tied]
            same = g[1:] == g[:-1]
            if not same.any():
                break
            twin = np.append(False, same) | np.append(same, False)
            tied, g = tied[twin], g[twin]
            word = self.words[pos[tied] + step]
            order = np.argsort(word)
            order = order[np.argsort(g[order], kind="stable")]
            pos[tied], word = pos[tied][order], word[order]
            fresh = np.append(False, (g[1:] == g[:-1]) & (word[1:] != word[:-1]))
            bump = np.zeros(len(pos), np.int64)
            bump[tied] = fresh
            group = group + np.cumsum(bump)
        lcp = np.zeros(len(pos), np.uint8)
        lcp[1:] = self.prefix(pos[:-1], pos[1:])
        return pos, lcp

    def _induce(self, pos: np.ndarray, lcp: np.ndarray, want_small: bool, low: np.ndarray, queues: list[DiskQueue]) -> None:
        """Pushes the suffixes one byte longer; their prefixes are one more than the least between their sources."""
        use = np.flatnonzero((pos > 0) & (self.small[pos - 1] == want_small))
        byte = self.text[pos[use] - 1]
        order = np.argsort(byte, kind="stable")
        use, byte = use[order], byte[order]
        upto, after = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
        seen = np.zeros(256, bool)
        if len(use):
            first = np.append(True, byte[1:] != byte[:-1])
            least = np.minimum(low[byte], upto[use])
            rest = np.flatnonzero(~first)
            least[rest] = self._least(lcp, use[rest - 1] + 1, use[rest])
            new = np.minimum(least + 1, self.depth).astype(np.uint8)
            cut = np.flatnonzero(first)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(use)]):
                c, end = int(byte[a]), int(use[b - 1]) + 1
                if not queues[c].pushed:
                    new[a] = 0
                queues[c].push(pos[use[a:b]] - 1, new[a:b])
                low[c] = after[end] if end < len(lcp) else 255
                seen[c] = True
        low[~seen] = np.minimum(low[~seen], upto[-1])

    @staticmethod
    def _least(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of each closed range, from minima over runs of doubling length."""
        if not len(lo):
            return np.empty(0, np.int64)
        length = hi - lo + 1
        level = np.frexp(length.astype(float))[1] - 1
        out, row, w = np.empty(len(lo), np.int64), lcp, 1
        for k in range(int(level.max()) + 1):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(row[lo[at]], row[hi[at] - w + 1])
            if 2 * w <= len(lcp):
                row, w = np.minimum(row[:-w], row[w:]), 2 * w
        return out

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, each with its prefix in common with the one before (up to the depth)."""
        start, start_lcp = self._starts()
        at = np.searchsorted(self.text[start], np.arange(257))
        large = [DiskQueue(self.share) for _ in range(256)]
        done_large = [DiskQueue(self.share) for _ in range(256)]
        tail = self.n - 1  # induced from the empty suffix, which is the smallest
        large[self.text[tail]].push(np.array([tail], np.int64), np.zeros(1, np.uint8))
        low, last = np.full(256, 255, np.int64), self.n

        def meet(pos: np.ndarray, lcp: np.ndarray, before: int | None) -> np.ndarray:
            lcp = lcp.copy()
            if before is None:
                lcp[0] = 0
            else:
                other = np.flatnonzero(self.text[before:before + self.depth] != self.text[pos[0]:pos[0] + self.depth])
                lcp[0] = other[0] if len(other) else self.depth
            return lcp

        for c in range(256):
            own, own_lcp = start[at[c]:at[c + 1]], start_lcp[at[c]:at[c + 1]]
            while (batch := large[c].pull()) is not None:
                pos, lcp = batch
                lcp = meet(pos, lcp, last)
                done_large[c].push(pos, lcp)
                self._induce(pos, lcp, False, low, large)
                last = int(pos[-1])
            if len(own):
                own_lcp = meet(own, own_lcp, last)
                self._induce(own, own_lcp, False, low, large)
                last = int(own[-1])
        small = [DiskQueue(self.share) for _ in range(256)]
        low, last, down = np.full(256, 255, np.int64), None, []
        for c in range(255, -1, -1):
            while (batch := small[c].pull()) is not None:
                pos, lcp = batch
                lcp = meet(pos, lcp, last)
                down.append((pos, lcp))
                self._induce(pos, lcp, True, low, small)
                last = int(pos[-1])
            if (batch := done_large[c].pull()) is not None:
                pos, up = batch[0][::-1], batch[1][::-1]
                lcp = meet(pos, np.append(np.uint8(0), up[:-1]), last)
                down.append((pos, lcp))
                self._induce(pos, lcp, True, low, small)
                last = int(pos[-1])
        pos = np.concatenate([d[0] for d in down])[::-1]
        lcp = np.concatenate([d[1] for d in down])[::-1]
        lcp = np.append(np.uint8(0), lcp[:-1])
        k = int(np.flatnonzero(pos == tail)[0])  # take the added byte out again
        if k + 1 < len(lcp):
            lcp[k + 1] = min(lcp[k], lcp[k + 1])
        return np.delete(pos, k), np.delete(lcp, k)


def classes(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """A number for each position of ``at``; two are equal where the ``depth`` bytes from there are."""
    pos, lcp = InducedSorter(text, depth).order()
    number = np.cumsum(lcp < depth)
    of = np.empty(len(text), np.int64)
    of[pos] = number
    return of[at]
