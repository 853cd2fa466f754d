"""Language-model scores by logistic mixing of hashed contexts, beside a smoothed unigram base.

A text is coded as the UTF-8 bytes of its lower-cased form and one end, each symbol by
the bits of a prefix code that depends on the symbol before it; any text has a code, so
the bits' probabilities make one of the text. For each bit several predictors look up
what followed their context, hashed with the place in the code: three symbols, the word
so far, and the word before with the word so far. Their counts are those of all training
texts: each task counts its own, in blocks that Spark adds up. A
logistic mixer takes the log odds of the predictors by weights that a gate picks: how
well the two word contexts are known. From these starting weights every text refines its
own as it goes, a segment at a time, by the errors made so far; a segment's bits are
coded by weights from before it.

The prefix codes come from the pairs of symbols of all training texts. The mixer's
starting weights are fitted on every bit of all training texts, for each of which the
counts leave out its text: tasks count how often which log odds, rounded to ROUND steps,
meet which bit, and Newton's steps are taken over these counts. The table of counts has a fixed number of slots (``slot_bits``), which bounds what is broadcast;
what it counts grows with the corpus, as do the tokens.

The base is the unigram probability of the tokens with all training counts. Tokens that
are at least a TOKEN_SHARE of all are broadcast; the others, once a text, are joined to
their counts.

Nulls: a null text is empty, it has the end alone; a null id is of no fold's remainder
and learns. Repeated rows are scored alike and each counts in training. Very long texts
are coded whole, in pieces that carry the contexts on. An empty table gives an empty
result; without training texts all counts are 0 and the predictors silent. Other
columns, of whatever name, are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import table
from evisift.llm.labelled import fold
from evisift.storage import materialize

#: Slots of the hashed contexts, as a power of two.
SLOT_BITS = 22
END = 256
SYMBOLS = 257
#: Predictors; with them goes a constant.
PREDICTORS = 3
#: What a count of zero stands for; steps of the log odds; levels at which a context's counts begin.
DELTA, STEPS, LEVELS = 0.1, 15.0, (4, 32, 256)
GATES = (len(LEVELS) + 1) ** 2
#: Steps of log odds that the mixer's fit takes together; how many such there are.
ROUND = 9
ROUNDED = 2 * ((127 + ROUND // 2) // ROUND) + 1
#: Symbols of a piece; counts of a block; bits of a segment; rate of refinement.
PIECE, BLOCK, SEGMENT, RATE = 1 << 14, 1 << 15, 512, 0.003
#: Tokens with at least this share of all are broadcast, so there are 1 / TOKEN_SHARE of them at most; different tokens that a task counts, at some five repeats of each, before it passes them on.
TOKEN_SHARE, TOKENS = 5e-6, 200_000
#: Tokens whose counts a task may hold as a map.
MAPPED = 1_000_000
MIX, NODE, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Low bits of a context's hash, which are given up for the two symbols in counting.
SPARE = np.uint64(18)
WORDLIKE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)] + [False])


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # of bytes: A-Z alone


def lowered_parts(column: pa.Array, size: int = 1000) -> Iterator[list[bytes]]:
    """lowered() of a column's texts, so many at a time."""
    for s in range(0, len(column), size):
        yield [(t or b"").lower() for t in column.slice(s, size).cast(pa.binary()).to_pylist()]


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts and each one's text; after the words come the ends, which are empty."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    of, token = pc.list_parent_indices(words).to_numpy().astype(np.int64), words.flatten().view(pa.large_binary())
    keep = pc.greater(pc.binary_length(token), 0)
    token, of = token.filter(keep), of[keep.to_numpy(zero_copy_only=False)]
    return pa.concat_arrays([token, pa.array([b""] * len(texts), pa.large_binary())]), np.append(of, np.arange(len(texts)))


# Codes -------------------------------------------------------------------------------------


@dataclass
class Codes:
    """Of (symbol before, symbol): where its bits begin in ``place`` and ``bit``, and how many there are. place: a hash of the symbol before and the inner node."""

    begin: np.ndarray
    length: np.ndarray
    place: np.ndarray
    bit: np.ndarray


def huffman(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each symbol the (inner node, bit) from the root of a tree of least weighted depth."""
    heap = [(float(w), k, (k, None, None)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    made = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (made, a[2], b[2])))
        made += 1
    out: list[list[tuple[int, int]]] = [[] for _ in weights]
    todo = [(heap[0][2], [])]
    while todo:
        (name, left, right), path = todo.pop()
        if left is None:
            out[name] = path
        else:
            node = name - len(weights)
            todo += [(left, [*path, (node, 0)]), (right, [*path, (node, 1)])]
    return out


def codes(pairs: np.ndarray) -> Codes:
    """From counts of (symbol before, symbol). Rare pairs lean on the symbol's own count, and every symbol on one."""
    own = (pairs.sum(0) + 1.0) / (pairs.sum() + SYMBOLS)
    begin, length, place, bit = [], [], [], []
    for before in range(SYMBOLS):
        for path in huffman(pairs[before] + own):
            begin.append(len(place))
            length.append(len(path))
            place += [before * 256 + n for n, _ in path]
            bit += [b for _, b in path]
    return Codes(np.array(begin, np.int64), np.array(length, np.uint8), (np.array(place, np.uint64) + np.uint64(1)) * NODE, np.array(bit, np.uint8))


# Contexts ----------------------------------------------------------------------------------


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Stream:
    """Symbols of texts, one after another, each with its end, in pieces of any size: contexts are carried on."""

    UP, DOWN = powers(PRIME, PIECE + 1), powers(INVERSE, PIECE + 1)

    def __init__(self, codes: Codes, slot_bits: int) -> None:
        self.codes = codes
        self.shift = np.uint64(64 - slot_bits)
        self.before = np.full(3, END, np.int64)
        self.word, self.word_up, self.last = np.uint64(0), np.uint64(1), np.uint64(0)

    def contexts(self, s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The symbol before each of ``s`` (PIECE at most), and hashes of the contexts."""
        n = len(s)
        ext = np.concatenate([self.before, s])
        b1, b2, b3 = ext[2 : n + 2], ext[1 : n + 1], ext[:n]
        b2 = np.where(b1 == END, END, b2)
        b3 = np.where(b2 == END, END, b3)
        at = np.arange(n)
        # hashes of prefixes: sums of symbols times powers of a prime; a difference of two of them, divided by the power, is that of the symbols between
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s.astype(np.uint64) + np.uint64(1)) * self.UP[:n])])
        in_word = WORDLIKE[s]
        begins = np.concatenate([[-1], np.maximum.accumulate(np.where(in_word, -1, at + 1))])  # of the word that goes on here; -1: in an earlier piece
        start = np.maximum(begins, 0)
        word = (sums - sums[start]) * self.DOWN[start]
        word = np.where(begins < 0, self.word + self.word_up * word, word)
        # the last word that has ended before, if in the same text
        ends = ~in_word & np.concatenate([[bool(self.word)], in_word[:-1]])
        at_end = np.maximum.accumulate(np.where(ends, at, -1))
        first = np.maximum.accumulate(np.where(s == END, at, -1))  # the last end of a text
        last = np.where(at_end > first, word[np.maximum(at_end, 0)], np.where(first >= 0, np.uint64(0), self.last))
        last = np.concatenate([[self.last], last])
        known = word[:-1] * MIX
        out = [(b1 | b2 << 9 | b3 << 18).astype(np.uint64) * NODE, known + np.uint64(1), (known ^ np.uint64(0x5555)) + last[:-1] * NODE]
        for h in out:  # the high bits are the mixed ones
            h ^= h >> np.uint64(29)
            h *= MIX
            h >>= SPARE
        if begins[-1] < 0:
            self.word_up = (self.UP[n : n + 1] * self.word_up)[0]
        else:
            self.word_up = self.UP[n - begins[-1]]
        self.word, self.last, self.before = word[-1], last[-1], ext[n:]
        return b1, out

    def bits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bits of each symbol, the bits, and each predictor's slots for them."""
        before, contexts = self.contexts(s)
        length, of, bit, node = self.path(before * SYMBOLS + s)
        return length, bit, [self.slots(c, of, node) for c in contexts]

    def path(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of (symbol before * SYMBOLS + symbol): how many bits each has, and of each bit its symbol's position, the bit and the hash of its place in the codes."""
        length = self.codes.length.take(code).astype(np.int64)
        upto = np.cumsum(length)
        of = np.zeros(int(upto[-1]) if len(upto) else 0, np.int64)
        of[upto[:-1]] = 1  # every symbol has a bit
        where = np.ones_like(of)  # steps from bit to bit, summed up
        if len(of):
            begin = self.codes.begin.take(code)
            where[0] = begin[0]
            where[upto[:-1]] = begin[1:] - begin[:-1] - length[:-1] + 1
        np.cumsum(of, out=of)
        np.cumsum(where, out=where)
        return length, of, self.codes.bit.take(where, mode="clip"), self.codes.place.take(where, mode="clip")

    def slots(self, context: np.ndarray, of: np.ndarray, node: np.ndarray) -> np.ndarray:
        h = context.take(of, mode="clip")  # take is slower where it checks positions
        h ^= node
        h *= MIX
        h >>= self.shift
        return h.view(np.int64)


def symbols(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes, each text with its end."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full(int(size.sum()) + len(texts), END, np.int64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(size + 1) - 1] = False
    out[keep] = np.frombuffer(b"".join(texts), np.uint8)
    return out


def pieces(texts: Iterator[bytes]) -> Iterator[np.ndarray]:
    """Symbols of the texts in arrays of PIECE."""
    held, size = [], 0
    for t in texts:
        for s in range(0, len(t) + 1, PIECE):
            part = symbols([t[s : s + PIECE]])
            held.append(part if s + PIECE > len(t) else part[:-1])
            size += len(held[-1])
            while size >= PIECE:
                whole = np.concatenate(held)
                yield whole[:PIECE]
                held, size = [whole[PIECE:]], len(whole) - PIECE
    if size:
        yield np.concatenate(held)


# Counts ------------------------------------------------------------------------------------


class Counts:
    """Zeros and ones by slot. Contexts that come again are counted together."""

    AT_ONCE = 1 << 20

    def __init__(self, codes: Codes, slot_bits: int) -> None:
        self.stream = Stream(codes, slot_bits)
        self.n = np.zeros(2 << slot_bits, np.int64)
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, s: np.ndarray) -> None:
        before, (*contexts, rare) = self.stream.contexts(s)
        _, of, bit, node = self.stream.path(before * SYMBOLS + s)
        at = self.stream.slots(rare, of, node)  # most of these come once
        at *= 2
        at += bit
        np.add.at(self.n, at, np.int64(1))
        both = (before << 9 | s).astype(np.uint64)
        self.held.append([c << SPARE | both for c in contexts])
        self.size += len(s)
        if self.size >= self.AT_ONCE:
            self.flush()

    def flush(self) -> None:
        for keys in zip(*self.held, strict=True):
            key = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key)))
            key = key[first]
            code = ((key >> np.uint64(9)) & np.uint64(511)).astype(np.int64) * SYMBOLS + (key & np.uint64(511)).astype(np.int64)
            for k in range(0, len(key), PIECE):
                _, of, bit, node = self.stream.path(code[k : k + PIECE])
                at = 2 * self.stream.slots(key[k : k + PIECE] >> SPARE, of, node) + bit
                np.add.at(self.n, at, times[k : k + PIECE].take(of, mode="clip"))
        self.held, self.size = [], 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        return blocks(self.n)


def blocks(n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks of counts, those that have any."""
    for k in range(0, len(n), BLOCK):
        part = n[k : k + BLOCK]
        if part.any():
            yield k // BLOCK, packed(np.pad(part, (0, BLOCK - len(part))))


def packed(n: np.ndarray) -> bytes:
    kind = np.uint8 if n.max() < 1 << 8 else np.uint16 if n.max() < 1 << 16 else np.int64
    return bytes([np.dtype(kind).itemsize]) + pa.compress(n.astype(kind).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, size: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[raw[0]]
    return np.frombuffer(pa.decompress(raw[1:], size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def scaled(n: np.ndarray) -> np.ndarray:
    """Zeros and ones as 16-bit numbers; where there are more, both are made smaller alike."""
    most = n.max(1, keepdims=True)
    return np.where(most > 65535, n * 65535 // np.maximum(most, 1), n).astype(np.uint16)


def gathered(texts: DataFrame, codes: Codes, slot_bits: int) -> DataFrame:
    """What tasks gather of (raw, learns): rows (token, c, n) of tokens in training and in all texts, and rows (block, counts)."""
    shared = texts.sparkSession.sparkContext.broadcast(codes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some, held = None, [], []

        def tokens() -> Iterator[pa.RecordBatch]:
            if some:
                t = pa.table({"token": pa.chunked_array([x[0] for x in some]), "c": np.concatenate([x[1] for x in some])})
                t = t.group_by("token", use_threads=False).aggregate([("c", "sum"), ("c", "count")]).combine_chunks()
                for b in t.select(["token", "c_sum", "c_count"]).to_batches():
                    yield _rows(*b.columns, None, None)
                some.clear()

        for b in batches:
            learns = iter(np.array(b.column(1).to_pylist(), bool))
            for texts in lowered_parts(b.column(0)):
                mine = np.fromiter(learns, bool, len(texts))
                token, of = tokens_of(texts)
                some.append((token, mine[of].astype(np.int64)))
                if sum(len(x[0]) for x in some) >= 5 * TOKENS:
                    yield from tokens()
                held += [t for t, x in zip(texts, mine, strict=True) if x]
                if sum(map(len, held)) > 1 << 22:
                    counts = counts or Counts(shared.value, slot_bits)
                    for s in pieces(iter(held)):
                        counts.add(s)
                    held = []
        if held:
            counts = counts or Counts(shared.value, slot_bits)
            for s in pieces(iter(held)):
                counts.add(s)
        yield from tokens()
        if counts:
            for block, data in counts.blocks():
                yield _rows([None], [None], [None], [block], [data])

    return materialize(texts.mapInArrow(gather, "token binary, c long, n long, block int, counts binary"), "gathered")


def _rows(token: pa.Array | list, c: pa.Array | list, n: pa.Array | list, block: list | None, counts: list | None) -> pa.RecordBatch:
    k = len(token)
    columns = [(token, pa.binary()), (c, pa.int64()), (n, pa.int64()), (block or pa.nulls(k), pa.int32()), (counts or pa.nulls(k), pa.binary())]
    return pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns], names=["token", "c", "n", "block", "counts"])


def added(blocks: DataFrame) -> DataFrame:
    """(block, counts), the counts of a block added up as they come, in two steps so that no task adds up all parts of a block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(BLOCK, np.int64)
                sums[block] += unpacked(raw, BLOCK)
        for block, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed(n)], pa.binary())], names=["block", "counts"])

    some = blocks.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(add, "block int, counts binary")
    return some.repartition("block").mapInArrow(add, "block int, counts binary")


# Mixing ------------------------------------------------------------------------------------


#: The logs of 16-bit counts, in STEPS.
LOGS = (np.log(np.arange(1 << 16) + DELTA) * STEPS).astype(np.float32)


def odds_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of 16-bit counts, in STEPS; counts below 0 are 0."""
    odds = LOGS.take(ones, mode="clip")
    odds -= LOGS.take(zeros, mode="clip")
    return np.clip(np.rint(odds, out=odds), -127, 127, out=odds).astype(np.int16)


def level_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """How well a context is known."""
    total = np.maximum(zeros, 0, dtype=np.int32, casting="same_kind") + np.maximum(ones, 0, dtype=np.int32, casting="same_kind")
    level = np.zeros(total.shape, np.int8)
    for least in LEVELS:
        level += total >= least
    return level


def table_of(n: np.ndarray) -> np.ndarray:
    """Of each slot its log odds, in STEPS, in the high byte, and in the low one how well it is known. n: 16-bit counts."""
    zeros, ones = n[:, 0].astype(np.int32), n[:, 1].astype(np.int32)
    return odds_of(zeros, ones) << 8 | level_of(zeros, ones)


@dataclass
class Bits:
    """Of each bit: the log odds of each predictor, the gate, and the bit as -1 or 1."""

    x: list[np.ndarray]
    gate: np.ndarray
    sign: np.ndarray

    @classmethod
    def of(cls, found: list[np.ndarray], bit: np.ndarray) -> Bits:
        x = [(v >> 8).astype(np.float32) for v in found]
        for v in x:
            v *= np.float32(1 / STEPS)
        return cls(x, cls.gate_of(found).astype(np.int64), bit.astype(np.float32) * 2 - 1)

    @staticmethod
    def gate_of(found: list[np.ndarray]) -> np.ndarray:
        return (found[-1] & 3) * (len(LEVELS) + 1) + (found[-2] & 3)

    @classmethod
    def joined(cls, parts: list[Bits]) -> Bits:
        return cls([np.concatenate(x) for x in zip(*[b.x for b in parts], strict=True)], np.concatenate([b.gate for b in parts]), np.concatenate([b.sign for b in parts]))


def newton(a: np.ndarray, t: np.ndarray, times: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of least cost for inputs ``a`` that met ``t`` so many times."""
    w = start.copy()
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (times * (t - p)) - (w - start)
        curve = (a * (times * p * (1 - p))[:, None]).T @ a + np.eye(PREDICTORS + 1)
        w += np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
    return w


@dataclass
class Mixer:
    """Weights of each gate."""

    w: np.ndarray

    @classmethod
    def fit(cls, bits: list[Bits]) -> Mixer:
        """The weights of least cost, by Newton's steps; they are held to equal shares as strongly as by a few bits."""
        start = np.append(np.full(PREDICTORS, 0.4), 0.0)
        w = np.tile(start, (GATES, 1))
        if bits:
            every = Bits.joined(bits)
            x = np.column_stack([*every.x, np.ones(len(every.gate))]).astype(np.float64)
            for g in range(GATES):
                here = every.gate == g
                w[g] = newton(x[here], every.sign[here] > 0, np.ones(here.sum()), start)
        return cls(w)

    @classmethod
    def fit_cells(cls, cells: np.ndarray) -> Mixer:
        """fit() of bits that were counted by cell (Cells)."""
        w = cls.fit([]).w
        met = np.flatnonzero(cells)
        rest, t = np.divmod(met, 2)
        x = np.ones((len(met), PREDICTORS + 1))
        for k in reversed(range(PREDICTORS)):
            rest, q = np.divmod(rest, ROUNDED)
            x[:, k] = (q - ROUNDED // 2) * (ROUND / STEPS)
        for g in range(GATES):
            here = rest == g
            w[g] = newton(x[here], t[here], cells[met[here]], w[g].copy())
        return cls(w)

    def odds(self, b: Bits) -> np.ndarray:
        """The log odds by the starting weights."""
        w = self.w.astype(np.float32)
        z = w[:, -1].take(b.gate, mode="clip")
        for k, x in enumerate(b.x):
            more = w[:, k].take(b.gate, mode="clip")
            more *= x
            z += more
        return z


def log1p(u: np.ndarray) -> np.ndarray:
    """As exact for small numbers as np.log1p, but for floats much faster."""
    w = u + 1
    d = w - 1  # what was added indeed
    return np.where(d == 0, u, np.log(w) * (u / np.maximum(d, 1e-30)))


def cost(z: np.ndarray, x: list[np.ndarray], bit: np.ndarray, size: np.ndarray, own: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Natural log of the probability of each text of ``size`` bits. z: log odds by the starting weights; x: those of each predictor, in STEPS; own: what each text has added to the weights so far, which is changed: after each whole segment a text's weights follow its errors."""
    order = np.argsort(-size, kind="stable")
    begin, size = (np.cumsum(size) - size)[order], size[order]
    rows, whole = -(-size // SEGMENT), size // SEGMENT
    at = np.cumsum(rows) - rows
    fill = [*[(0, np.int8)] * len(x), (1, np.int8), (60, np.float32)]  # what fills a text's last segment has no cost
    every = [np.full((int(rows.sum()), SEGMENT), f, kind) for f, kind in fill]
    for to, of in zip(every, [*x, 2 * bit.view(np.int8) - 1, z], strict=True):
        to = to.reshape(-1)
        for i, k, n in zip((at * SEGMENT).tolist(), begin.tolist(), size.tolist(), strict=True):
            to[i : i + n] = of[k : k + n]
    v, lost = own[order].astype(np.float32), np.zeros(len(size))
    for s in range(int(rows[0]) if len(size) else 0):
        k = int(np.searchsorted(-rows, -s))  # texts that have a segment here, and those of them that have a whole one
        m = int(np.searchsorted(-whole, -s))
        *xs, sign, e = [x.take(at[:k] + s, axis=0, mode="clip").astype(np.float32, copy=False) for x in every]
        e += v[:k, -1:]
        for i, x in enumerate(xs):
            e += x * (v[:k, i : i + 1] * np.float32(1 / STEPS))
        e *= -sign
        np.exp(np.minimum(e, 30, out=e), out=e)
        a, c = e[:, : SEGMENT // 2], e[:, SEGMENT // 2 :]
        lost[:k] += log1p(a + c + a * c).sum(1)  # two bits at once; e ** 60 at most
        e, sign = e[:m], sign[:m]
        e /= 1 + e
        e *= sign
        for i, x in enumerate(xs):
            v[:m, i] += rate / STEPS * np.einsum("ks,ks->k", e, x[:m])
        v[:m, -1] += rate * e.sum(1)
    out = np.zeros(len(size))
    out[order] = -lost
    own[order] = v
    return out


@dataclass
class Model:
    codes: Codes
    table: np.ndarray
    mixer: Mixer
    slot_bits: int

    #: Symbols that are scored at once at most, and such that small texts are taken together to: those stay in a core's cache.
    AT_ONCE, TOGETHER = 1 << 20, 1 << 18

    def found(self, stream: Stream, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bits of each symbol, the bits, and what the table has for each predictor."""
        length, bit, slots = stream.bits(s)
        return length, bit, [self.table.take(x, mode="clip") for x in slots]

    def bits(self, stream: Stream, parts: list[np.ndarray]) -> tuple[np.ndarray, Bits]:
        """Bits of each symbol, and the bits, of pieces that follow each other."""
        lengths, bit, found = zip(*[self.found(stream, s) for s in parts], strict=True)
        return np.concatenate(lengths), Bits.joined([Bits.of(f, b) for f, b in zip(found, bit, strict=True)])

    def inputs(self, stream: Stream, parts: Iterator[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Bits of each symbol, and the log odds by the starting weights, those of the predictors and the bits as cost() takes them."""
        made = []
        for s in parts:
            length, bit, found = self.found(stream, s)
            made.append((length, self.mixer.odds(Bits.of(found, bit)), *[(v >> 8).astype(np.int8) for v in found], bit))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each text. Texts of like lengths are scored together: they go on for as long."""
        out, held, size = np.zeros(len(texts)), [], 0
        for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
            t = texts[k]
            if held and size + len(t) > min(self.AT_ONCE, self.TOGETHER):
                out[held] = self.together([texts[i] for i in held])
                held, size = [], 0
            if len(t) > self.AT_ONCE:
                out[k] = self.alone(t)
            else:
                held.append(k)
                size += len(t) + 1
        if held:
            out[held] = self.together([texts[i] for i in held])
        return out

    def together(self, texts: list[bytes]) -> np.ndarray:
        length, z, *x, bit = self.inputs(Stream(self.codes, self.slot_bits), pieces(iter(texts)))
        upto = np.append(0, np.cumsum(length))[np.append(0, np.cumsum([len(t) + 1 for t in texts]))]
        return cost(z, x, bit, np.diff(upto), np.zeros((len(texts), PREDICTORS + 1)))

    def alone(self, text: bytes) -> float:
        """A long text, part by part."""
        stream, own, total = Stream(self.codes, self.slot_bits), np.zeros((1, PREDICTORS + 1)), 0.0
        for s in pieces(iter([text])):
            length, z, *x, bit = self.inputs(stream, iter([s]))
            total += cost(z, x, bit, length.sum(keepdims=True), own)[0]
        return total


def fit_codes(texts: DataFrame) -> Codes:
    """From the pairs of symbols of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            before = END
            for s in pieces(t for texts in lowered_parts(b.column("text")) for t in texts):
                n += np.bincount(np.append(before, s[:-1]) * SYMBOLS + s, minlength=len(n))
                before = s[-1]
        pair = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(n[pair])], names=["pair", "n"])

    n = np.zeros(SYMBOLS * SYMBOLS)
    for r in texts.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # SYMBOLS bounds them
        n[r.pair] = r.n
    return codes(n.reshape(SYMBOLS, SYMBOLS))


class Cells:
    """How often which gate and rounded log odds of the predictors meet which bit, over texts whose own counts are left out. n: counts of all slots, as 16-bit numbers."""

    #: Texts up to so many symbols are gone through once.
    ONCE = 1 << 17

    def __init__(self, codes: Codes, n: np.ndarray, slot_bits: int) -> None:
        self.codes, self.slot_bits = codes, slot_bits
        self.slots = np.zeros(len(n), np.int64)  # of a slot: its counts and, in the high half, where a text has met it; what other texts leave there is never read
        self.slots.view(np.uint16).reshape(-1, 4)[:, :2] = n
        self.at = self.slots.view(np.int32)[1::2]
        self.cells = np.zeros(2 * GATES * ROUNDED**PREDICTORS, np.int64)

    def add(self, texts: list[bytes]) -> None:
        """Small texts go through Stream together, a piece at most."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            if held and size + len(t) >= PIECE:
                self.together(held)
                held, size = [], 0
            if len(t) >= self.ONCE:
                self.alone(t)
            else:
                held.append(t)
                size += len(t) + 1
        if held:
            self.together(held)

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bits of each symbol, the bits, and their slots by predictor."""
        stream = Stream(self.codes, self.slot_bits)
        for s in pieces(iter(texts)):
            length, bit, slots = stream.bits(s)
            yield length, bit, np.stack(slots)

    def together(self, texts: list[bytes]) -> None:
        length, bit, slots = [np.concatenate(x, -1) for x in zip(*self.pieces(texts), strict=True)]
        upto = np.append(0, np.cumsum(length))[np.append(0, np.cumsum([len(t) + 1 for t in texts]))].tolist()
        n, own = np.empty(slots.shape, np.uint32), np.empty(slots.shape, np.int64)
        for a, b in zip(upto, upto[1:], strict=False):
            met = slots[:, a:b].ravel()
            self.at[met] = np.arange(len(met), dtype=np.int32)
            both = self.slots.take(met, mode="clip").reshape(PREDICTORS, -1)
            first = both >> 32  # the same for bits of the same slot
            n[:, a:b] = both  # the low half
            times = np.bincount((2 * first + bit[a:b]).ravel(), minlength=2 * len(met))
            own[:, a:b] = times.astype(np.int32).view(np.int64).take(first, mode="clip")  # both counts in one look-up
        self.tally(bit, n, own.view(np.int32).reshape(*slots.shape, 2))

    def alone(self, text: bytes) -> None:
        """A long text, part by part."""
        own = np.zeros((len(self.slots), 2), np.int32)
        for _, bit, slots in self.pieces([text]):
            np.add.at(own.reshape(-1), (2 * slots + bit).ravel(), np.int32(1))
        for _, bit, slots in self.pieces([text]):
            self.tally(bit, self.slots.take(slots, mode="clip").astype(np.uint32), own.take(slots, 0, mode="clip"))

    def tally(self, bit: np.ndarray, n: np.ndarray, own: np.ndarray) -> None:
        """n: the counts of all, both in a number; own: the text's own."""
        n = n.view(np.uint16).reshape(own.shape) - own
        zeros, ones = n[..., 0], n[..., 1]
        level = level_of(zeros[-2:], ones[-2:])
        odds = odds_of(zeros, ones)
        odds += ROUNDED // 2 * ROUND + ROUND // 2
        odds //= ROUND
        cell = (level[1] * np.int8(len(LEVELS) + 1) + level[0]).astype(np.int32)
        for q in odds:
            cell *= ROUNDED
            cell += q
        cell *= 2
        cell += bit
        np.add.at(self.cells, cell, np.int64(1))


def fit_mixer(texts: DataFrame, codes: Codes, n: np.ndarray, slot_bits: int) -> Mixer:
    """On every bit of all texts. n: counts of all slots, as 16-bit numbers."""
    shared = texts.sparkSession.sparkContext.broadcast((codes, n))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Cells(*shared.value, slot_bits)
        for b in batches:
            for some in lowered_parts(b.column("text")):
                made.add(some)
        for block, data in blocks(made.cells):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "counts"])

    cells = np.zeros(2 * GATES * ROUNDED**PREDICTORS, np.int64)
    for r in added(texts.mapInArrow(tally, "block int, counts binary")).toLocalIterator():
        part = cells[r.block * BLOCK : (r.block + 1) * BLOCK]
        part += unpacked(r.counts, BLOCK)[: len(part)]
    return Mixer.fit_cells(cells)


def fit(docs: DataFrame, learns: Column, slot_bits: int = SLOT_BITS) -> tuple[Model, DataFrame]:
    """The model of docs (doc_id, text) for which ``learns`` holds, and the table of all tokens (token, c, n)."""
    texts = docs.filter(learns).select("text")
    codes = fit_codes(texts)
    got = gathered(docs.select("text", learns.alias("learns")), codes, slot_bits)
    tokens = materialize(got.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "tokens")
    n = np.zeros(2 << slot_bits, np.uint16)
    for r in added(got.filter("block IS NOT NULL").select("block", "counts")).mapInArrow(halved, "block int, counts binary").toLocalIterator():
        part = np.frombuffer(r.counts, np.uint16)
        n[r.block * BLOCK : (r.block + 1) * BLOCK] = part[: len(n) - r.block * BLOCK]
    n = n.reshape(-1, 2)
    return Model(codes, table_of(n), fit_mixer(texts, codes, n, slot_bits), slot_bits), tokens


def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of counts as 16-bit numbers."""
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([scaled(unpacked(raw, BLOCK).reshape(-1, 2).astype(np.int64)).tobytes()])], names=["block", "counts"])


# Scores ------------------------------------------------------------------------------------


def scored(docs: DataFrame, learns: Column, **how: int) -> DataFrame:
    """A row a row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), total_bits and bits_per_byte."""
    spark = docs.sparkSession
    model, tokens = fit(docs, learns, **how)
    total, distinct, every, different = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rest = total + 0.5 * (distinct + 1)
    often = (F.col("n") >= max(every * TOKEN_SHARE, 1)) & (F.octet_length("token") <= 256)
    found = tokens.filter(often).select("token", "c").toArrow()  # TOKEN_SHARE bounds them
    c = found["c"].to_numpy()
    hot = found["token"].combine_chunks().cast(pa.large_binary()), np.log10((c + 0.5) / rest), c > 0
    shared = spark.sparkContext.broadcast((model, hot))  # slot_bits and TOKEN_SHARE bound them
    kind = dict(docs.dtypes)["doc_id"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (often, logs, learnt) = shared.value
        key = TaskContext.get().partitionId() << 40
        names = ["key", "doc_id", "bytes", "n_tokens", "n_known", "base", "score", "token"]
        for b in batches:
            s = 0
            for texts in lowered_parts(b.column(1)):
                size, ids = len(texts), b.column(0).slice(s, len(texts))
                log = model.score(texts)
                token, of = tokens_of(texts)
                n = np.bincount(of, minlength=size)
                token = token.dictionary_encode()
                rank = pc.fill_null(pc.index_in(token.dictionary, value_set=often), -1).to_numpy().astype(np.int64)
                rank = np.where(rank < 0, len(often) + np.arange(len(rank)), rank)  # often ones first, in one order everywhere
                met = np.sort(of << 32 | rank[token.indices.to_numpy()])
                first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
                times, of, rank = np.diff(np.append(first, len(met))), met[first] >> 32, met[first] & 0xFFFFFFFF
                sure = rank < len(often)
                i, j, k = of[sure], rank[sure], times[sure]
                base, known = np.bincount(i, k * logs[j], size), np.bincount(i, k * learnt[j], size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(range(key, key + size), pa.int64()), ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(log), pa.nulls(size, pa.binary())], names=names)
                if m := int((~sure).sum()):
                    rare = token.dictionary.take(pa.array(rank[~sure] - len(often))).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key + of[~sure]), pa.nulls(m, ids.type), pa.nulls(m, pa.int64()), pa.array(times[~sure]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), rare], names=names)
                key += size
                s += size

    rows = materialize(docs.select("doc_id", "text").mapInArrow(take, f"key long, doc_id {kind}, bytes long, n_tokens long, n_known long, base double, score double, token binary"), "scores")
    counts = tokens.filter(~often).select("token", "c")
    rare = rows.filter("token IS NOT NULL").select("key", "token", "n_tokens")
    if (parts := different // MAPPED) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        counts, rare = counts.repartition(parts, "token"), rare.repartition(parts, "token")
    rare = rare.join(counts.hint("shuffle_hash"), "token")  # nothing is sorted; a task maps some MAPPED tokens
    rare = rare.groupBy("key").agg(F.sum(F.col("n_tokens") * F.log10((F.col("c") + 0.5) / F.lit(rest))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n_tokens")).otherwise(0)).alias("known"))
    out = rows.filter("token IS NULL").join(rare, "key", "left")
    bits = -F.col("score") / F.lit(math.log(2))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") / F.lit(math.log(10))).alias("score"), bits.alias("total_bits"), (bits / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    return scored(docs, ~held).withColumn("held_out", held)
