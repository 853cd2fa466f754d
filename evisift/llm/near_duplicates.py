"""N-gram Jaccard join with Bayesian candidate pruning.

Documents whose sets of five-word shingles are equal form one class. Classes
whose MinHash values agree in a band of four are candidates; their values are
compared sixteen at a time, and a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below TOLERANCE.
What is left connects classes to candidate groups. In a group every pair is
compared in the same way and those that survive are verified exactly from the
shingle sets, block by block: a task holds two blocks of a group at most and
gives sums and a spanning forest, never the pairs.

A pair at the threshold shares no band with a probability of 3e-6 (24 bands of
4) and is dropped wrongly with one of 1e-6 a comparison; both fall steeply
above it. Nothing is capped: large bands and groups are cut into blocks, each of
which meets every other. Keys that hold many rows (bands, groups, fingerprints,
copies) are joined by broadcasting these keys alone, a thousand at most.

Words are runs of characters other than ASCII white space, in lower case. A text
of fewer than five words has one shingle, all its words. Null and empty texts
have none: they link with nothing and are classes of their own. Very long texts
count with all their words; one has to fit a task. Rows that repeat an id count
as rows of their own. A class is named by its smallest id that is not null, and
of its rows one is kept: the one with that id, of several such rows the one with
the smallest hash of its text, and of rows that repeat both any one. An empty
table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import BROADCAST_ROWS, WORD, batched, components, groups, join_hot, quoted, table, text_or_empty
from evisift.storage import materialize, unused

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
#: Members of a band that are compared in one task; classes of a block that are verified in one task, with another block, and bytes of their sets, about.
CELL, BLOCK, BLOCK_BYTES = 2048, 384, 4 << 20
TOKEN = re.compile(WORD)
MIX, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_RNG = np.random.default_rng(5)
ODD = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
MASK = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word n-grams, sorted."""
    words = TOKEN.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits, each from the least image of the set under one hash function."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        x = (s[at : at + 2048][None, :] ^ MASK[:, None]) * ODD[:, None]
        np.minimum(low, x.min(1), out=low)
    return ((low * PRIME) >> np.uint64(48)).astype(np.uint16)


def matches_needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP ... values compared: the least number of equal ones that keeps a pair. With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose tail above t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(one: np.ndarray, all_: np.ndarray, among: np.ndarray, needed: list[int]) -> np.ndarray:
    """Those of the rows ``among`` of all_ that the incremental comparison with one doesn't drop."""
    same = np.zeros(len(among), np.int64)
    for k, least in enumerate(needed):
        part = slice(k * STEP, (k + 1) * STEP)
        same += (all_[among, part] == one[part]).sum(1)
        keep = same >= least
        among, same = among[keep], same[keep]
        if not len(among):
            break
    return among


def forest(n: int, near) -> list[tuple[int, int]]:  # noqa: ANN001
    """Edges of a spanning forest over 0 .. n-1; near(x, left) gives those of left that link with x."""
    left, edges, queue = np.arange(1, n), [], [0]
    while True:
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if len(hit):
                edges += [(x, y) for y in hit.tolist()]
                queue += hit.tolist()
                left = left[~np.isin(left, hit)]
        if not len(left):
            return edges
        queue, left = [int(left[0])], left[1:]


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Two hashes of a row's id and text; rows agree in both if they agree in id and text."""
    both = F.col(id_col), text_or_empty(text_col)
    return F.xxhash64(*both), F.xxhash64(F.lit(7), *both)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, j, fp, n, sig): hashes of the row, fingerprint and size of the shingle set and its MinHash values. Empty sets have no fp."""
    k, j = row_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), k.alias("k"), j.alias("j"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n, sig = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py())
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "k", "j")), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["id", "k", "j", "fp", "n", "sig"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, k bigint, j bigint, fp binary, n bigint, sig binary")


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(u, v): a spanning forest of the pairs of classes (fp, sig) that share a band and survive the pruning."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * 2 * ROWS + 1, F.lit(2 * ROWS))))
    keys = classes.select("fp", F.explode(band).alias("k"))
    many = keys.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
    met = materialize(join_hot(keys, many, "k", "size", BANDS * classes.count()), "bands")
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    met = met.withColumn("b", F.pmod(F.xxhash64("fp", "k"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.join(classes.select("fp", "sig"), "fp").select("k", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "fp", "sig")
    met = met.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    needed = matches_needed(threshold, tolerance)
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[bytes, bytes]]:
            for _, rows in groups(batches, ["k", "i", "j"]):
                fp = rows.column("fp").to_pylist()
                sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(fp), HASHES)
                for x, y in forest(len(fp), lambda x, left, sig=sig: survivors(sig[x], sig, left, needed)):
                    yield fp[x], fp[y]

        yield from batched(edges(), schema)

    return met.mapInArrow(run, "u binary, v binary")


def intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``cols``, by products of slices of the incidence matrix."""
    ids = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(ids, return_inverse=True, return_counts=True)
    everywhere = int((count == len(sets)).sum())
    use = (count[column] > 1) & (count[column] < len(sets))  # sets have no repeats
    _, column = np.unique(column[use], return_inverse=True)
    owner = owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.full((len(rows), len(cols)), float(everywhere), np.float32)
    wide = 1024
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        s, e = np.searchsorted(column, [at, at + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[s:e], column[s:e] - at] = 1
        out += m[rows] @ m[cols].T
    return out


def surviving(left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which pairs of rows of left and of right the incremental comparison doesn't drop."""
    out = np.zeros((len(left), len(right)), bool)
    every = np.arange(len(right))
    for x, one in enumerate(left):
        out[x, survivors(one, right, every, needed)] = True
    return out


def verify(docs: DataFrame, members: DataFrame, threshold: float, tolerance: float, id_col: str, text_col: str) -> DataFrame:
    """members: (fp, sig, k, j, count, group, size, words). Returns rows (u, v, links): links of class u within a block or between two, v a neighbour in a spanning forest or null."""
    k, j = row_keys(id_col, text_col)
    texts = docs.select(k.alias("k"), j.alias("jt"), text_or_empty(text_col).alias("text"))
    wanted = members.select("k", "j", "count", F.col("fp").alias("want"))
    found = texts.join(F.broadcast(wanted), "k") if wanted.count() <= BROADCAST_ROWS else join_hot(texts, wanted, "k", "count", docs.count())
    found = found.filter("j = jt").select("want", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def rows(b: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
            for want, text in zip(b.column("want").to_pylist(), b.column("text"), strict=True):
                if want in seen:  # rows that repeat id and text
                    continue
                s = shingles(text.as_py())
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want:
                    seen.add(want)
                    yield want, s.tobytes()

        for b in batches:
            yield from batched(rows(b), pa.schema([("fp", pa.binary()), ("s", pa.binary())]), 500)

    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("words") * 8 / BLOCK_BYTES)).cast("int")
    m = members.withColumn("b", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.select("fp", "sig", "count", "b", F.xxhash64("group").alias("k"), F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))
    m = found.mapInArrow(sets, "fp binary, s binary").join(m, "fp").select("k", "i", "j", "b", "fp", "sig", "count", "s")
    m = m.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")
    needed = matches_needed(threshold, tolerance)
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple[bytes, bytes | None, int]]:
            for (_, i, j), rows in groups(batches, ["k", "i", "j"]):
                fp = rows.column("fp").to_pylist()
                first = [x for x in range(len(fp)) if not x or fp[x] != fp[x - 1]]  # other tasks may have met the same row again
                rows = rows.take(first)
                fp = [fp[x] for x in first]
                sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(fp), HASHES)
                count, b = rows.column("count").to_numpy(), rows.column("b").to_numpy()
                left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
                if not len(left) or not len(right):
                    continue
                alive = surviving(sig[left], sig[right], needed) & (left[:, None] != right[None, :])
                left, right, alive = left[alive.any(1)], right[alive.any(0)], alive[alive.any(1)][:, alive.any(0)]
                if not len(left):
                    continue
                use = np.union1d(left, right)
                s = [np.frombuffer(rows.column("s")[x].as_py(), np.uint64) for x in use.tolist()]
                left, right = np.searchsorted(use, left), np.searchsorted(use, right)
                fp, count = [fp[x] for x in use.tolist()], count[use]
                size = np.array([len(x) for x in s], np.float64)
                inter = intersections(s, left, right).astype(np.float64)
                whole = np.zeros((len(fp), len(fp)), bool)
                whole[np.ix_(left, right)] = alive & (inter >= threshold * (size[left][:, None] + size[right][None, :] - inter) - 1e-9)
                whole |= whole.T
                links = whole @ count
                tree: dict[int, list[int]] = {}
                for x, y in forest(len(fp), lambda x, rest, whole=whole: rest[whole[x, rest]]):
                    tree.setdefault(x, []).append(y)
                for x in range(len(fp)):
                    if links[x]:
                        near = tree.get(x, [None])
                        yield fp[x], None if near[0] is None else fp[near[0]], int(links[x])
                        for y in near[1:]:
                            yield fp[x], fp[y], 0

        yield from batched(out(), schema)

    return m.mapInArrow(run, "u binary, v binary, links bigint")


def matched(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> DataFrame:
    """(id, k, j, fp, class_id, n_links, kept), one row per row of docs."""
    feat = materialize(features(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "features")
    total = feat.count()
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "j", "row")).alias("rep")
    classes = feat.filter("n > 0").groupBy("fp", "sig", "n").agg(rep, F.count("*").alias("count"))
    classes = materialize(classes, "classes")
    found = components(candidate_edges(classes, threshold, tolerance))
    found = found.select(F.col("node").alias("fp"), F.col("label").alias("group"))
    found = materialize(found.join(classes.select("fp", "sig", "n", "rep.k", "rep.j", "count"), "fp"), "groups")
    sizes = found.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("words"))
    members = materialize(join_hot(found, sizes, "group", "size", found.count()), "members")
    checked = materialize(verify(docs, members, threshold, tolerance, id_col, text_col), "links")
    label = components(checked.filter("v is not null").select("u", "v")).select(F.col("node").alias("fp"), "label")
    links = checked.groupBy(F.col("u").alias("fp")).agg(F.sum("links").alias("links"))
    classes = classes.select("fp", "rep", "count").join(label, "fp", "left").join(links, "fp", "left")
    classes = materialize(classes.withColumn("label", F.coalesce("label", "fp")), "classes")
    best = classes.groupBy("label").agg(F.min("rep").alias("best"), F.count("*").alias("c"))
    classes = join_hot(classes, best, "label", "c", total)
    classes = materialize(classes.select("fp", "count", "best", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    rows = join_hot(feat.filter("fp is not null").select("id", "k", "j", "row", "fp"), classes, "fp", "count", total)
    rows = rows.select("id", "k", "j", "fp", F.col("best.id").alias("class_id"), "n_links", (F.col("row") == F.col("best.row")).alias("kept"))
    alone = feat.filter("fp is null").select("id", "k", "j", "fp", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return rows.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: its id, class_id (the smallest id that links reach), n_links (other rows linked directly) and kept (whether it is the class's one row that stays)."""
    out = matched(docs, id_col, text_col, threshold, tolerance)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs without the rows that have another row of their class before them: the kept row of each class stays, all columns with it, and so do all rows without words."""
    k, j, words, copies = unused(docs.columns, "k", "j", "words", "copies")
    found = materialize(matched(docs, id_col, text_col, threshold, tolerance).filter("fp is not null").select("k", "j", "kept"), "near")
    stay = found.groupBy("k", "j").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).filter("kept")
    own = quoted(docs.columns)
    has = text_or_empty(text_col).rlike(WORD)
    keys = row_keys(id_col, text_col)
    rows = docs.filter(has).withColumn(k, keys[0]).withColumn(j, keys[1])
    rows = join_hot(rows, stay.select(F.col("k").alias(k), F.col("j").alias(words), F.col("copies").alias(copies)), k, copies, found.count())
    rows = rows.filter(F.col(j) == F.col(words))
    hashable = [c for c, kind in zip(own, docs.dtypes, strict=True) if "map<" not in kind[1] and "variant" not in kind[1]]
    again = rows.filter(F.col(copies) > 1).groupBy(k, j).agg(F.min_by(F.struct(*own), F.xxhash64(*hashable)).alias(words))  # rows that repeat id and text
    again = again.select(*[F.col(words)[c].alias(c) for c in docs.columns])
    return rows.filter(F.col(copies) == 1).select(*own).unionByName(again).unionByName(docs.filter(~has))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, min(r.v) AS class_id, (SELECT count(*) FROM l WHERE l.u = d.doc_id) AS n_links, min(r.v) = d.doc_id AS kept
FROM documents d JOIN r ON r.u = d.doc_id GROUP BY d.doc_id
"""
