"""Whole texts to token ids, with the ids of words remembered.

Both vocabularies cut a text into stretches that never interact: the word vocabulary drops white space, the byte-level
one joins one space to what follows it. Each distinct stretch goes through the tokenizers library once (new ones many
at a time, as one text whose ids are then parted by their lengths) and its ids are kept in a bounded table of the
Python worker, so text made of known words costs a lookup a word. Byte-level stretches are cut, looked up and put together
in arrays, some megabytes of text at a time; what the ids stand for is then compared with the text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .bytesets import hashes, slices

#: Words that keep their length in bytes and may stand side by side: printable ASCII and Latin letters.
_PLAIN = re.compile("(?: [!-~\u00a1-\u00ac\u00ae-\u012f\u0132-\u017f]+(?:\n[!-~]+)*)+")


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, e in ranges:
        t[a:e + 1] = True
    return t


_SPACE, _SHOWN = _flags((9, 13), (32, 32)), _flags((33, 126))
_LETTER = _flags((65, 90), (97, 122))
_MARK = _flags((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))  # no apostrophe: contractions are words of their own


class CachedEncoder:
    """``encode(utf8) -> little-endian unsigned 32-bit ids``, equal to the library's on the whole text."""

    def __init__(self, name: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.spaced = name.startswith("byte")
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that a token stands for
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix("" if self.spaced else "</w>"))
        if self.spaced:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the others are written from U+0100 on
            byte = dict(zip(map(chr, shown), shown)) | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
            by_id = sorted((i, token) for token, i in vocabulary.items())
            self.stands = np.frombuffer(b"".join(bytes(byte.get(c, 0) for c in token) for _, token in by_id), np.uint8)
            self.stands_at = np.cumsum(self.sizes) - self.sizes
            self.line_feed = vocabulary["\u010a"]
            self._forget()

    def _cut(self, text: bytes) -> list[bytes]:
        return (text.lower() if text.isascii() and b"<|" not in text else text).split()  # this vocabulary folds case

    def _parted(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        """Index after each stretch's last id, from their lengths; none if these do not part the ids."""
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, wanted)
        return at + 1 if len(ends) and at[-1] < len(ends) and np.array_equal(ends[at], wanted) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of plain words, encoded as one text; empty if the lengths do not part it as expected."""
        ids = self._ids(b" ".join(words).decode())
        cuts = self._parted(ids, np.array([len(w) for w in words]))
        if cuts is None:
            return {}
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *cuts[:-1]], cuts)}

    def _are_plain(self, words: list[bytes]) -> bool:
        text = b" ".join(words).decode()
        return "<|" not in text and _PLAIN.fullmatch(" " + text) is not None

    def _alone(self, words: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(words), 5000):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in words[i:i + 5000]], add_special_tokens=False)
            yield from (array("I", e.ids).tobytes() for e in found)

    def _learn(self, seen: set[bytes]) -> None:
        new = [w for w in seen if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known = {w: self.known[w] for w in seen if w in self.known}
        other: list[bytes] = []
        for i in range(0, len(new), 400):
            part = new[i:i + 400]
            if not self._are_plain(part):
                plain = [w for w in part if self._are_plain([w])]
                other += set(part).difference(plain)
                part = plain
            got = self._together(part) if part else {}
            self.known.update(got)
            other += [] if got else part
        self.known.update(zip(other, self._alone(other)))

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """Ids of some megabytes of text; the caller bounds what it hands over at once."""
        if self.spaced:
            return self._encode_spaced(list(texts))
        cut = [self._cut(t) for t in texts]
        self._learn(set().union(*cut))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    # ---- the byte-level vocabulary, in arrays

    def _forget(self) -> None:
        """An empty table of stretches: slots by hash, each with the stretch's number, and the ids of all one after the other."""
        self.slots, self.number = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of stretches, and which bytes may stand in one that is learnt side by side with others.

        A cut before white space behind a printable character or Latin letter, and one between a letter and a mark other
        than the apostrophe, lie between two words of the vocabulary whatever else the text holds.
        """
        shown, letter = _SHOWN[data], _LETTER[data]
        first = (data >= 0xC3) & (data <= 0xC5)  # U+00C0 to U+017F: letters but for two
        second = np.zeros(len(data), bool)
        second[1:] = first[:-1]
        letter |= second
        letter[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        cut = np.zeros(len(data), bool)
        cut[1:] = (shown | second)[:-1] & _SPACE[data[1:]] | letter[:-1] & _MARK[data[1:]]
        cut[off[:-1][off[:-1] < len(data)]] = True
        return np.flatnonzero(cut), shown | first | second

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each stretch by its hash, -1 where it is not known."""
        mask = len(self.slots) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        out, todo = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(todo):
            held = self.slots[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.number[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def _keep(self, key: np.ndarray, number: np.ndarray) -> None:
        """Puts new distinct hashes into the slots, of which at most half are taken."""
        if 2 * len(self.start) > len(self.slots):
            old = np.flatnonzero(self.slots)
            key, number = np.append(self.slots[old], key), np.append(self.number[old], number)
            size = 1 << int(2 * len(self.start)).bit_length()
            self.slots, self.number = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        mask = len(self.slots) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        while len(key):
            free = self.slots[slot] == 0
            self.slots[slot[free]], self.number[slot[free]] = key[free], number[free]  # of several, the last stays
            rest = self.slots[slot] != key
            key, number, slot = key[rest], number[rest], (slot[rest] + 1) & mask

    def _learn_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, good: np.ndarray) -> None:
        """Ids of new stretches. Plain ones are encoded as one text in which each starts with its own space or line feed, or
        with a line feed put before it, which is an id by itself."""
        bad = np.append(0, np.cumsum(~good))
        led = ((data[starts] == 32) | (data[starts] == 10)) & (ends - starts > 1)
        plain = bad[ends] - bad[starts] == led
        order = np.flatnonzero(plain)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # stretches, their ids, how many each
        other = [np.flatnonzero(~plain)]
        for i in range(0, len(order), 400):
            part = order[i:i + 400]
            put = ~led[part]
            size = ends[part] - starts[part] + put
            end = np.cumsum(size)
            text = data[np.maximum(np.arange(end[-1]) + np.repeat(starts[part] - put - (end - size), size), 0)]
            text[(end - size)[put]] = 10
            ids = self._ids(text.tobytes().decode())
            cuts = self._parted(ids, size)
            first = np.append(0, cuts[:-1]) if cuts is not None else None
            if cuts is None or (ids[first[put]] != self.line_feed).any():
                other.append(part)
                continue
            found.append((part, np.delete(ids, first[put]), cuts - first - put))
        other = np.concatenate(other)
        alone = list(self._alone([data[a:e].tobytes() for a, e in zip(starts[other].tolist(), ends[other].tolist())]))
        found.append((other, np.frombuffer(b"".join(alone), "<u4"), np.array([len(x) // 4 for x in alone], np.int64)))
        which, ids, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        had = len(self.start) - 1
        self.flat = np.append(self.flat, ids)
        self.start = np.append(self.start, self.start[-1] + np.cumsum(n))
        self._keep(key[which], np.arange(had, had + len(which)))

    def _encode_spaced(self, texts: list[bytes]) -> list[bytes]:
        apart = [i for i, t in enumerate(texts) if b"<|" in t]  # special strings are found before anything is cut
        own = dict(zip(apart, self._alone([texts[i] for i in apart])))
        off = np.cumsum([0] + [0 if i in own else len(t) for i, t in enumerate(texts)])
        data = np.frombuffer(b"".join(t for i, t in enumerate(texts) if i not in own), np.uint8)
        starts, good = self._pieces(data, off)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        key = np.maximum(hashes(data, starts, ends), np.uint64(1)) if len(starts) else np.empty(0, np.uint64)
        number = self._find(key)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new = lost[np.unique(key[lost], return_index=True)[1]]
            if len(self.start) + len(new) > self.limit:
                self._forget()
                new = np.unique(key, return_index=True)[1]
                lost = np.arange(len(key))
            self._learn_pieces(data, starts[new], ends[new], key[new], good)
            number[lost] = self._find(key[lost])
        n = self.start[number + 1] - self.start[number]
        ids = self.flat[np.arange(n.sum()) + np.repeat(self.start[number] - (np.cumsum(n) - n), n)]
        cuts = 4 * np.append(0, np.cumsum(n))[np.searchsorted(starts, off)]
        raw = ids.astype("<u4").tobytes()
        out = [own[i] if i in own else raw[a:e] for i, (a, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))]
        size = self.sizes[ids]
        same = size.sum() == len(data) and np.array_equal(self.stands[np.arange(len(data)) + np.repeat(self.stands_at[ids] - (np.cumsum(size) - size), size)], data)
        return out if same else list(self._alone(texts))  # two stretches of one hash


def encoder(name: str) -> CachedEncoder:
    """The worker's encoder for a vocabulary file.

    This package travels with the job and is built anew for each task, so what shall outlive a task in its Python
    worker hangs on an installed module.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if name not in kept:
        kept[name] = CachedEncoder(name)
    return kept[name]


def encoded(batches: Iterator[pa.RecordBatch], text: str, name: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small slices of the batches with the ids of their texts; null counts as empty."""
    for b in slices(batches, text):
        texts = b.column(text).cast(pa.large_binary()).fill_null(b"").to_pylist()
        yield b, encoder(name).encode(texts)
