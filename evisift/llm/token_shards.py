"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents are encoded, joined with end marks, and cut into sequences of one length,
which are written as a table in the shared folder. Its counts by input partition tell
every sequence's index, its place among all. A keyed Feistel network with cycle
walking permutes these indices, and the permuted index is the sequence's global slot.
Shards are ranges of slots: each task gathers one and writes it in slot order, so
reading training data is a sequential read, and slot s lies
``stride * (s - first_slot)`` bytes into its shard.

Ids of words met before are kept (bounded): where no piece of a BPE model has U+2581
after another character, a text's ids are those of its words. Other models, and texts
that hold U+2581, are encoded whole.

A record is its index (int64), its number of ids (int32), a zero (int32) and the
ids, of two bytes or, for vocabularies beyond 65,536, of four, the rest zero. Files
are written beside their place and moved, so a task that runs again writes the same
file, and a run again over the same files gives the same shards and manifest. Only a
partition's last sequence is not full.

Null and empty texts give an end mark alone; a very long text is encoded by parts and
runs over many sequences; repeated rows are written again, each at places of its own,
so that ties don't arise. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import batched, table, text_or_empty
from evisift.storage import materialize, new_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LENGTH, KEY, HEADER = 1024, 20250101, 16
#: Bytes of a shard, about, and texts that become Python strings at once.
SHARD_BYTES, TEXTS = 64 << 20, 200
#: Sequences of a block of the written table, and of those that are dealt to shards together, about.
BLOCK, DEALT = 256, 2048
#: Words that a worker keeps, about; letters of the longest one; letters that are encoded at once, about.
KEPT, LONGEST, PART = 400_000, 64, 1 << 20
SPACE = "▁"


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(n), at the places ``index``: a balanced Feistel network on the least even number of bits that holds n, walked on until the image is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest()) for r in range(rounds)]
    x, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            f = (right ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(64 - 32)) & mask) if half <= 32 else left ^ (f & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class Words:
    """Ids of texts, as bytes. Words met before are kept; beyond KEPT only those of the part at hand."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.kind = id_type(self.library.vocab_size())
        m = pb2.ModelProto()
        m.ParseFromString(proto)
        n, t = m.normalizer_spec, m.trainer_spec
        identity = n.add_dummy_prefix and n.escape_whitespaces and not (n.remove_extra_whitespaces or n.precompiled_charsmap or t.treat_whitespace_as_suffix)
        #: Whether a text's ids are those of its words.
        self.apart = bool(t.model_type == pb2.TrainerSpec.BPE and t.byte_fallback and identity) and not any(SPACE in p.piece.lstrip(SPACE) for p in m.pieces)
        self.end = self.raw([self.library.eos_id()])
        self.kept: dict[str, bytes] = {}

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def parts(self, text: str) -> Iterator[list[str] | bytes]:
        """The words of parts of a text, or the ids of a whole one, and an end mark."""
        if not self.apart or SPACE in text:
            yield self.raw(self.library.encode(text))
        elif "  " in text or text[:1] == " " or text[-1:] == " ":
            yield re.split("(?<=[^ ]) (?=[^ ])", text)
        else:
            begin = 0
            while (cut := text.find(" ", begin + PART)) >= 0:
                yield text[begin:cut].split(" ")
                begin = cut + 1
            yield text[begin:].split(" ")
        yield self.end

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The texts' ids, with an end mark after each; about PART letters at a time."""
        held, letters = [], 0
        for text in texts:
            for part in self.parts(text):
                held.append(part)
                letters += min(len(text), PART)
                if letters >= PART:
                    yield self._ids(held)
                    held, letters = [], 0
        yield self._ids(held)

    def _ids(self, held: list[list[str] | bytes]) -> bytes:
        met = set().union(*(p for p in held if isinstance(p, list)))
        new = [w for w in met if w not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept = {w: self.kept[w] for w in met if w in self.kept}
        self.kept.update(zip(new, map(self.raw, self.library.encode(new, num_threads=1)), strict=True))
        out = b"".join([p if isinstance(p, bytes) else b"".join(map(self.kept.__getitem__, p)) for p in held])
        for w in new:
            if len(w) > LONGEST:
                del self.kept[w]
        return out


@cache
def words_of(proto: bytes) -> Words:
    """One for each model and worker, so that its words serve all its tasks."""
    return Words(proto)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield from b.column("text").slice(at, TEXTS).to_pylist()


def encoded(texts: DataFrame, model: bytes, length: int) -> DataFrame:
    """(part, block, n, ids): ids of BLOCK sequences, compressed, in order by input partition; n is how many ids."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack, part = words_of(shared.value), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        size = words.kind.itemsize * length * BLOCK

        def rows() -> Iterator[tuple]:
            held, block = b"", 0
            for x in chain(words.encode(texts_of(batches)), [None]):
                held += x or b""
                end = len(held) if x is None else len(held) // size * size
                for at in range(0, end, size):
                    ids = held[at : min(at + size, end)]
                    yield part, block, len(ids) // words.kind.itemsize, pack.compress(ids)
                    block += 1
                held = held[end:]

        yield from batched(rows(), schema, 16)

    return texts.mapInArrow(run, "part int, block int, n bigint, ids binary")


def dealt(blocks: DataFrame, first: dict[int, int], total: int, item: int, length: int, key: int, width: int) -> DataFrame:
    """(shard, n, raw): slots and records of n sequences of a shard, compressed together; a shard has width slots."""
    shared = blocks.sparkSession.sparkContext.broadcast(first)
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pack, unpack = shared.value, zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def split(held: list[np.ndarray]) -> Iterator[tuple]:
            index = np.concatenate([r[:, :8].copy().view("<i8")[:, 0] for r in held])
            slot = permute(index, total, key)
            records, order = np.concatenate(held), np.argsort(slot, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(slot[order] // width)) + 1):
                yield int(slot[at[0]] // width), len(at), pack.compress(slot[at].astype("<i8").tobytes() + records[at].tobytes())

        def rows() -> Iterator[tuple]:
            held, count = [], 0
            for b in batches:
                for part, block, n, ids in zip(*(b.column(c).to_pylist() for c in ("part", "block", "n", "ids")), strict=True):
                    m = -(-n // length)
                    records = np.zeros((m, HEADER + item * length), np.uint8)
                    records[:, :8] = (first[part] + block * BLOCK + np.arange(m, dtype="<i8")).view(np.uint8).reshape(m, 8)
                    records[:, 8:12] = np.minimum(n - length * np.arange(m), length).astype("<i4").view(np.uint8).reshape(m, 4)
                    records[:, HEADER:] = np.frombuffer(unpack.decompress(ids).ljust(m * item * length, b"\0"), np.uint8).reshape(m, -1)
                    held.append(records)
                    count += m
                    if count >= DEALT:
                        yield from split(held)
                        held, count = [], 0
            if held:
                yield from split(held)

        yield from batched(rows(), schema, 64)

    return blocks.mapInArrow(run, "shard int, n int, raw binary")


def write_shards(docs: DataFrame, path: str, model: str = MODEL, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES, text_col: str = "text") -> DataFrame:
    """Writes the shards below ``path`` when the result is computed, and gives their manifest: shard, file (its name below path), first_slot, n_sequences, n_tokens, stride, sha256."""
    with open(model, "rb") as f:  # noqa: PTH123  the driver's own copy of the vocabulary
        proto = f.read()
    blocks = materialize(encoded(docs.select(text_or_empty(text_col).alias("text")), proto, length), "blocks")
    first, total = {}, 0
    for part, ids in blocks.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # a row a partition
        first[part] = total
        total += -(-ids // length)
    if not total:
        return docs.sparkSession.createDataFrame([], "shard int, file string, first_slot bigint, n_sequences bigint, n_tokens bigint, stride int, sha256 string")
    item = Words(proto).kind.itemsize
    stride = HEADER + item * length
    width = max(1, shard_bytes // stride)
    rows = dealt(blocks, first, total, item, length, key, width).repartitionById(-(-total // width), F.col("shard")).sortWithinPartitions("shard")
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("n_tokens", pa.int64()), ("stride", pa.int32()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()

        def close(shard: int, records: np.ndarray, seen: np.ndarray) -> tuple:
            if not (seen == 1).all():
                raise RuntimeError(f"shard {shard} lacks sequences or has one twice")
            name, made = f"shard-{shard:06d}.bin", f"{root}/.shard-{shard:06d}.{attempt}"
            with fs.open_output_stream(made) as out:
                out.write(records.data)
            fs.move(made, f"{root}/{name}")
            tokens = int(records[:, 8:12].copy().view("<i4").sum(dtype=np.int64))
            return shard, name, shard * width, len(records), tokens, stride, hashlib.sha256(records.data).hexdigest()

        def done() -> Iterator[tuple]:
            now, records, seen = None, None, None
            for b in batches:
                for shard, n, raw in zip(*(b.column(c) for c in ("shard", "n", "raw")), strict=True):
                    shard, n = shard.as_py(), n.as_py()
                    if shard != now:
                        if now is not None:
                            yield close(now, records, seen)
                        now, size = shard, min(width, total - shard * width)
                        records, seen = np.zeros((size, stride), np.uint8), np.zeros(size, np.int32)
                    raw = unpack.decompress(raw.as_buffer())
                    at = np.frombuffer(raw, "<i8", n) - shard * width
                    records[at] = np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, stride)
                    seen[at] += 1
            if now is not None:
                yield close(now, records, seen)

        yield from batched(done(), schema)

    return rows.mapInArrow(run, "shard int, file string, first_slot bigint, n_sequences bigint, n_tokens bigint, stride int, sha256 string")


def read_slots(path: str, begin: int, count: int, length: int = LENGTH, kind: str = "<u2") -> Iterator[tuple[int, np.ndarray]]:
    """(index, ids) of ``count`` records of a shard from its record ``begin`` on: one seek, then a sequential read; a reader resumes at any record. kind: of the ids, by the vocabulary."""
    fs, where = pafs.FileSystem.from_uri(path)
    stride = HEADER + np.dtype(kind).itemsize * length
    with fs.open_input_file(where) as f:
        f.seek(begin * stride)
        for _ in range(count):
            raw = f.read(stride)
            if len(raw) < stride:
                return
            n = int(np.frombuffer(raw, "<i4", 1, 8)[0])
            yield int(np.frombuffer(raw, "<i8", 1)[0]), np.frombuffer(raw, kind, n, HEADER)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
