"""Which of many words stand in a text: an automaton (Aho and Corasick) over UTF-8 bytes, and the scan that asks it, inside tasks, in Arrow batches.

A byte that no word has ends every match, so texts are cut there, and what was found in a
piece is kept for its next occurrence. A piece is read once, whatever words there are.
Memory follows the words' bytes, of which who calls has bounded the number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Bytes of texts that are looked through together, and words found in them that are handed on together.
AT_ONCE = 1 << 20
#: Pieces of at most so many bytes are kept with the words in them, until so many bytes are held, a piece counting as PIECE more than its words do.
LONGEST, KEPT, PIECE = 64, 1 << 25, 150


def distinct(codes: np.ndarray) -> np.ndarray:
    """np.unique, which hashes, at many times the cost of sorting."""
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


class Finder:
    """Of texts (bytes), the places in ``words`` of those that are in each, ascending. Words are different and not empty."""

    def __init__(self, words: Sequence[bytes]) -> None:
        letters = sorted(set().union(*words))
        others = sorted(set(range(256)).difference(letters))
        self.cut = bytes(others[:1])
        self.table = bytes(others[0] if b in others else b for b in range(256))
        self.kind = np.full(256, len(letters), np.uint8 if len(letters) < 256 else np.int32)
        self.kind[letters] = range(len(letters))
        self.kinds, self.longest = len(letters) + 1, max(map(len, words), default=0)
        # states are beginnings of words; levels: those of a length, as (state before, byte, state)
        go, last, levels = {}, [], [[] for _ in range(self.longest)]
        for w in words:
            s = 0
            for level, b in zip(levels, w):  # noqa: B905  as far as the word goes
                n = go.get(s << 8 | b)
                if n is None:
                    n = go[s << 8 | b] = len(go) + 1
                    level.append((s, b, n))
                s = n
            last.append(s)
        self.number = np.full(len(go) + 1, -1, np.int32)
        self.number[last] = range(len(words))
        # fail: the longest other state that ends what was read; end: the longest word that does, which may be the state; after: the same for what ends a word
        next_, fail, self.end = np.zeros((len(go) + 1, self.kinds), np.int32), np.zeros(len(go) + 1, np.int32), np.zeros(len(go) + 1, np.int32)
        for level in levels:
            before, byte, at = np.array(level, np.int64).T
            kind = self.kind[byte]
            fail[at] = next_[before, kind]  # as yet the step from the other state
            next_[before, kind] = at
            next_[at] = next_[fail[at]]
            self.end[at] = np.where(self.number[at] >= 0, at, self.end[fail[at]])
        self.next, self.after = next_, self.end[fail]
        self.mark = np.zeros(len(words), bool)
        self.known: dict[bytes, bytes] = {}
        self.room = KEPT

    def read(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The places of the words in each piece, as the bytes of an array. Pieces are read side by side, a byte of each at a time, long ones in windows that share as much as a word may have."""
        found, held, size = [[] for _ in pieces], [], 0
        stride = max(LONGEST, self.longest)
        for i, piece in enumerate(pieces):
            for lo in range(0, len(piece) - self.longest + 1, stride) if len(piece) > stride else (0,):
                held.append((i, window := piece[lo : lo + stride + self.longest - 1]))
                size += len(window)
                if size >= AT_ONCE:
                    self.windows(held, found)
                    held, size = [], 0
        self.windows(held, found)
        return [b"".join(f) for f in found]

    def windows(self, held: list[tuple[int, bytes]], found: list[list[bytes]]) -> None:
        """Adds to ``found`` the places of the words in the windows, each with the number of its piece."""
        held = sorted(held, key=lambda h: -len(h[1]))
        if not held or not len(held[0][1]):
            return
        size = np.array([len(w) for _, w in held])
        owner, at = np.array([i for i, _ in held]), np.cumsum(size) - size
        body, states = self.kind[np.frombuffer(b"".join(w for _, w in held), np.uint8)], len(self.end)
        s, step, hits = np.zeros(len(held), np.int64), self.next.ravel(), []
        for j, n in enumerate(len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")):
            s = step[s[:n] * self.kinds + body[at[:n] + j]].astype(np.int64)
            end = self.end[s]
            some = np.flatnonzero(end)
            hits.append(owner[some] * states + end[some])
        code = distinct(np.concatenate(hits))
        every = [code]
        while len(code):
            i, e = np.divmod(code, states)
            e = self.after[e]
            code = distinct(i[e > 0] * states + e[e > 0])
            every.append(code)
        i, e = np.divmod(distinct(np.concatenate(every)), states)
        ids, some = self.number[e].tobytes(), np.flatnonzero(np.diff(i, prepend=-1))
        for k, (lo, hi) in zip(i[some].tolist(), pairwise([*(4 * some).tolist(), len(ids)]), strict=True):
            found[k].append(ids[lo:hi])

    def __call__(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        if self.room < 0:
            self.known.clear()
            self.room = KEPT
        known = self.known
        pieces = [set(t.translate(self.table).split(self.cut)) if self.cut else {t} for t in texts]
        new = list(set().union(*pieces).difference(known))
        for piece, ids in zip(new, self.read(new), strict=True):
            known[piece] = ids
            self.room -= len(ids) + PIECE
        found = []
        for p in pieces:
            self.mark[np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32)] = True
            found.append(np.flatnonzero(self.mark))
            self.mark[found[-1]] = False
        for piece in new:
            if len(piece) > LONGEST:
                self.room += len(known.pop(piece)) + PIECE
        return found


def together(bodies: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of AT_ONCE bytes, unless one text has more, each with the place of its first."""
    lo, held, size = 0, [], 0
    for body in bodies:
        held.append(body.as_py())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield lo, held
            lo, held, size = lo + len(held), [], 0
    if held:
        yield lo, held


#: The finder that this worker used last, and its name.
_LAST: list[tuple[str, Finder]] = []


def finder(name: str, words: Sequence[bytes]) -> Finder:
    """A worker's tasks share one."""
    if not _LAST or _LAST[0][0] != name:
        _LAST[:] = []
        _LAST[:] = [(name, Finder(words))]
    return _LAST[0][1]


def listing(name: str, get: Callable[[], Sequence[bytes]], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (key, body) the rows (key, words): the words of each body."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = get()
        find, values = finder(name, words), pa.array(words, pa.binary())
        for b in batches:
            for lo, texts in together(b.column("body")):
                ids = find(texts)
                upto = pa.array(np.append(0, np.cumsum([len(i) for i in ids])), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, len(ids)), pa.ListArray.from_arrays(upto, values.take(pa.array(np.concatenate(ids))))], names=[key, "words"])

    return scan


def counting(name: str, get: Callable[[], tuple[Sequence[bytes], Sequence[int]]], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (key, body) the rows (key, n, place, word): how many words a body has, and of these the one with the lowest place. The words are in the order of their places. Bodies without any are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, places = get()
        find, values, places = finder(name, words), pa.array(words, pa.binary()), pa.array(places, pa.int64())
        for b in batches:
            n, first = np.zeros((2, b.num_rows), np.int64)
            for lo, texts in together(b.column("body")):
                for i, ids in enumerate(find(texts), lo):
                    if len(ids):
                        n[i], first[i] = len(ids), ids[0]
            at, first = pa.array(np.flatnonzero(n)), pa.array(first[n > 0])
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), pa.array(n[n > 0]), places.take(first), values.take(first)], names=[key, "n", "place", "word"])

    return scan
