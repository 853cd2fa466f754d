"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled to weighted machines: the normaliser (dummy prefix, white space
to U+2581), the transducer of its pieces (a piece's weight is minus its score, for BPE
its merge rank), byte fallback for characters without a piece, and the acceptor of
pairs, which says whether a piece may follow another. Composed with an input they
give a lattice whose states are a position and the piece that ends there; weights add
up along a path in the tropical semiring and the path of least weight is the encoding.

A BPE model merges by rank and not by sums of weights, so the plain shortest path is
not what it means. Its acceptor of pairs gives weight 0 to two pieces if merging their
joined text gives these two again, and infinity else. One path of finite weight is
left, the BPE encoding. Unigram models have an acceptor of weight 0 throughout.

No piece has U+2581 after another character, so a text is the concatenation of the
paths of its words, and paths of words met before are kept (bounded). Words of one
length go through their lattices together: as one path at most reaches a position of
a BPE lattice with finite weight, the first that is found is the least. Words with
fallback, very long ones and those of unigram models take ``shortest``, arc by arc.

Nulls are encoded as empty texts, to no ids; very long texts are encoded whole;
repeated rows get equal ids. Of unigram paths of equal weight the one whose last piece
begins first stands, as it does before that. Texts that hold U+2581 decode with a
space there, as the model says; decoding gives every other text back. An empty table
gives an empty result. Columns besides id and text are not read, but decode() carries
all along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import table, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Entries of each worker's tables of words and of pairs, at most; then they start anew.
KEPT_WORDS, KEPT_PAIRS = 100_000, 100_000
#: Bits of the tables of piece hashes and of pairs. Longer words than LONG are encoded one by one.
PIECE_BITS, PAIR_BITS, LONG = 18, 20, 40
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a piece where there is none: a word's begin, bytes.
FALLBACK = -2
#: Characters of the texts that are encoded together, about.
BATCH = 4 << 20


@dataclass
class Pieces:
    """What a model file holds: surface and score of each id (None if it is no text), the bytes' ids, and its settings."""

    surface: list[str | None]
    score: list[float]
    byte: dict[int, int]
    unknown: int
    bpe: bool
    prefix: bool
    #: Tells models apart.
    name: str = ""

    @classmethod
    def read(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb2

        m = pb2.ModelProto()
        with open(path, "rb") as f:  # noqa: PTH123  the driver's own copy of the vocabulary
            raw = f.read()
        m.ParseFromString(raw)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type not in (1, 2) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE and unigram models with the identity normaliser are supported")
        kinds = pb2.ModelProto.SentencePiece
        text = [p.piece if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else None for p in m.pieces]
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        return cls(text, [p.score for p in m.pieces], byte, unknown, m.trainer_spec.model_type == 2, spec.add_dummy_prefix, hashlib.sha256(raw).hexdigest())


class Transducer:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.ids = {s: i for i, s in enumerate(pieces.surface) if s}
        self.longest = max(map(len, self.ids), default=1)
        order = {s: r for r, s in enumerate(sorted(set(pieces.score), reverse=True))}
        self.rank = [order[s] for s in pieces.score]
        self.worst = 10 - min(pieces.score, default=0.0)
        self.raw = [b"" if s is None else s.encode() for s in pieces.surface]
        for value, i in pieces.byte.items():
            self.raw[i] = bytes([value])
        if any(SPACE in s.lstrip(SPACE) for s in self.ids):
            raise ValueError("a piece has U+2581 after another character")
        stop = "" if any("\n" in s for s in self.ids) else "\n"
        self.unit = re.compile(f"{stop and stop + '|'}{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+")
        self.halves: dict[int, tuple[int, int]] = {}
        if pieces.bpe:
            for i in list(self.ids.values()):
                if len(s := pieces.surface[i]) > 1:
                    whole, last = self.merged(s)
                    if whole != [i]:
                        del self.ids[s]  # merging never makes it
                    else:
                        self.halves[i] = last
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.pair_key, self.pair_good = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        texts = sorted(self.ids)
        hashes = np.array([self._hash(t) for t in texts], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        value = np.array([self.ids[t] for t in texts], np.int32)
        slot = (hashes >> np.uint64(64 - PIECE_BITS)).astype(np.int64)
        first = np.unique(slot, return_index=True)[1]
        self.piece_hash, self.piece_id = np.zeros(1 << PIECE_BITS, np.uint64), np.full(1 << PIECE_BITS, -1, np.int32)
        self.piece_hash[slot[first]], self.piece_id[slot[first]] = hashes[first], value[first]
        rest = np.setdiff1d(np.arange(len(texts)), first)
        rest = rest[np.argsort(hashes[rest])]
        self.rest_hash, self.rest_id = np.append(hashes[rest], np.uint64(0)), np.append(value[rest], np.int32(-1))

    def merged(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Ids by merging, for the compilation of short texts; and the last two merged."""
        every = {s: i for i, s in enumerate(self.pieces.surface) if s} if not hasattr(self, "_every") else self._every
        self._every = every
        parts, last = list(text), (-1, -1)
        while True:
            found = [(self.rank[every[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in every]
            if not found:
                return [every.get(p, -1) for p in parts], last
            k = min(found)[1]
            last = (every.get(parts[k], -1), every.get(parts[k + 1], -1))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand after a: going back through the merges that made a's right and b's left edge, latest first, the two edges could never have been merged first."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        rank, halves, surface, ids = self.rank, self.halves, self.pieces.surface, self._every
        x, y, good = a, b, True
        soonest_a = soonest_b = 1 << 40  # rank of the merge that takes the edge up, on either side
        while True:
            both = ids.get(surface[x] + surface[y])
            if both is not None and rank[both] < soonest_a and rank[both] <= soonest_b:
                good = False
                break
            hx, hy = halves.get(x), halves.get(y)
            if hx is None and hy is None:
                break
            if hy is None or (hx is not None and rank[x] > rank[y]):
                soonest_a, x = rank[x], hx[1]
            else:
                soonest_b, y = rank[y], hy[0]
        self.pairs[key] = good
        return good

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h ^ ord(c)) * int(MIX) & (1 << 64) - 1
            h ^= h >> 31
        return h

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        slot = (h >> np.uint64(64 - PIECE_BITS)).astype(np.int64)
        there, out = self.piece_hash[slot], self.piece_id[slot]
        other = np.nonzero(there != h)
        if len(other[0]):
            left = h[other]
            found = np.full(len(left), -1, np.int32)
            taken = np.flatnonzero(out[other] >= 0)
            at = np.searchsorted(self.rest_hash[:-1], left[taken])
            found[taken] = np.where(self.rest_hash[at] == left[taken], self.rest_id[at], -1)
            out[other] = found
        return out

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = ((key.astype(np.uint64) * MIX) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        good, new = self.pair_good[slot], self.pair_key[slot] != key
        if new.any():
            found, where = np.unique(key[new], return_inverse=True)
            found_good = np.array([self.follows(k >> 32, k & 0xFFFFFFFF) for k in found.tolist()], bool)
            good[new] = found_good[where]
            self.pair_key[slot[new]], self.pair_good[slot[new]] = key[new], good[new]
        return good

    def paths(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word's path. Words of one length go through their lattices together, position by position."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w) if self.pieces.bpe and len(w) <= LONG else 0, []).append(w)
        for n, same in by.items():
            if not n:
                yield from ((w, self.shortest(w)) for w in same)
                continue
            codes = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
            h, arcs = np.zeros_like(codes), []
            for k in range(min(n, self.longest)):
                h = (h[:, : n - k] ^ codes[:, k:]) * MIX
                h ^= h >> np.uint64(31)
                arcs.append(self._lookup(h))
            last, back = np.full((len(same), n + 1), -1, np.int32), np.zeros((len(same), n + 1), np.int32)
            for i in range(1, n + 1):
                todo = np.arange(len(same))
                for size in range(min(i, self.longest), 0, -1):
                    p = arcs[size - 1][todo, i - size]
                    some = np.flatnonzero(p >= 0)
                    if not len(some):
                        continue
                    q = last[todo[some], i - size]
                    ok = q < 0
                    check = np.flatnonzero(~ok)
                    if len(check):
                        ok[check] = self._follow(q[check], p[some][check])
                    some = some[ok]
                    last[todo[some], i], back[todo[some], i] = p[some], i - size
                    todo = np.delete(todo, some)
                    if not len(todo):
                        break
                last[todo, i], back[todo, i] = -2, i - 1
            at, every = np.full(len(same), n), np.arange(len(same))
            out, used = np.zeros((len(same), n), np.int32), np.zeros(len(same), np.int64)
            raw = np.zeros(len(same), bool)
            while (live := at > 0).any():
                used += live
                piece = last[every, at]
                raw |= live & (piece == -2)
                out[every[live], n - used[live]] = piece[live]
                at = np.where(live, back[every, at], 0)
            begin = n - used
            for w, row, s, odd in zip(same, out, begin.tolist(), raw.tolist(), strict=True):
                yield w, self.shortest(w) if odd else row[s:].tobytes()

    def fallback(self, ch: str) -> list[int]:
        return [self.pieces.byte[x] for x in ch.encode("utf-8", "replace")] if self.pieces.byte else [self.pieces.unknown]

    def arcs(self, text: str, end: int) -> Iterator[tuple[int, int, float]]:
        """The lattice's arcs into a position: where they begin, their piece (FALLBACK for a character without one) and their weight."""
        for begin in range(max(0, end - self.longest), end):
            piece = self.ids.get(text[begin:end])
            if piece is not None:
                yield begin, piece, -self.pieces.score[piece]
        if text[end - 1] not in self.ids:
            yield end - 1, FALLBACK, self.worst

    def pair(self, before: int, piece: int) -> float:
        """Weight of a pair of pieces: 0 or infinity. Nothing merges over a fallback or a word's begin."""
        if not self.pieces.bpe or before < 0 or piece < 0:
            return 0.0
        return 0.0 if self.follows(before, piece) else inf

    def shortest(self, text: str) -> bytes:
        """Ids of one word as int32, along the path of least weight through its lattice. For each position: by the piece that ends there, the least weight and the arc it came by. Without an acceptor of pairs one state a position is enough."""
        best: list[dict[int, tuple[float, int, int]]] = [{FALLBACK: (0.0, -1, -1)}]
        for end in range(1, len(text) + 1):
            here: dict[int, tuple[float, int, int]] = {}
            for begin, piece, weight in self.arcs(text, end):
                for before, (so_far, _, _) in best[begin].items():
                    total = so_far + weight + self.pair(before, piece)
                    if total < (here[piece][0] if piece in here else inf):
                        here[piece] = (total, begin, before)
            if not self.pieces.bpe:
                least = min(here, key=lambda p: here[p][:2])
                here = {least: here[least]}
            best.append(here)
        out, at = [], len(text)
        piece = min(best[at], key=lambda p: best[at][p][:2]) if text else FALLBACK
        while at:
            out.append([piece] if piece >= 0 else self.fallback(text[at - 1]))
            _, at, piece = best[at][piece]
        return np.array([x for part in reversed(out) for x in part], np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32."""
        if not text:
            return b""
        words = self.unit.findall((SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE))
        kept = self.words
        new = [w for w in set(words) if w not in kept]
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = list(set(words))
        kept.update(self.paths(new))
        return b"".join(map(kept.__getitem__, words))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As encode, but the words that all the texts have anew are taken together."""
        prefix = SPACE if self.pieces.prefix else ""
        words = [self.unit.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        kept, every = self.words, set().union(*words)
        new = [w for w in every if w not in kept]
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = list(every)
        kept.update(self.paths(new))
        return [b"".join(map(kept.__getitem__, w)) for w in words]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.pieces.prefix and text[:1] == " " else text


COMPILED: dict[str, Transducer] = {}


def compiled(pieces: Pieces) -> Transducer:
    """The worker's machine for a model, compiled once."""
    if pieces.name not in COMPILED:
        COMPILED.clear()
        COMPILED[pieces.name] = Transducer(pieces)
    return COMPILED[pieces.name]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_tokens, token_ids, and round_trip: whether decoding them gives the text back. The model is read by the driver and broadcast (its size is the vocabulary's)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.read(model))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for whole in batches:
            part = np.cumsum(pc.utf8_length(whole.column("text")).to_numpy()) // BATCH
            for at, end in zip(*(x.tolist() for x in (np.searchsorted(part, np.unique(part)), np.searchsorted(part, np.unique(part), "right"))), strict=True):
                b = whole.slice(at, end - at)
                texts = b.column("text").to_pylist()
                coded = machine.encode_all(texts)
                ids = [np.frombuffer(c, np.int32) for c in coded]
                same = [machine.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                n = np.array([len(i) for i in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), pa.array(same)], ["id", "n_tokens", "token_ids", "round_trip"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens bigint, token_ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "token_ids", name: str = "text") -> DataFrame:
    """tokens with a column ``name``: the text that its ids stand for (null for null)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces.read(model))

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(shared.value)
        for ids in parts:
            yield pd.Series([None if i is None else machine.decode(np.asarray(i)) for i in ids], dtype=object)

    return tokens.withColumn(name, text(F.col(ids_col)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
