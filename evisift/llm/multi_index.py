"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. A
vector lies in the cell of its two nearest codewords and asks the nearest cells
of the grid, which the multi-sequence traversal visits in the order of the sum
of the two distances. How many it visits is fitted: neighbours at the threshold
are drawn around the vectors of a bounded sample, and the visits are those that
meet the target share of them. Every vector met is verified in double precision.

A pair is found if either vector's visits reach the other's cell, and counted
once. Equal vectors are taken together before. Cells are cut into blocks, which
a task verifies against a block of the vectors that ask; it gives sums and a
spanning forest, never the pairs. Nothing is capped. Codebooks grow with the
table up to WORDS words a half, and the sample with them.

A pair is linked if its cosine in double precision is at least the threshold; a
product within 1e-9 of it is computed again in extended precision, so that
rounding neither adds nor loses a link. Vectors that are null, empty, zero or hold
null or non-finite components link with nothing, nor do vectors of different
lengths. Rows that repeat an id count as rows of their own, and each that bears
the component's smallest id is kept; a null id stays null and can't name a
component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import batched, components, groups, join_by_key, join_hot, table
from evisift.llm.near_duplicates import forest
from evisift.llm.topk import usable
from evisift.storage import materialize

THRESHOLD, RECALL = 0.95, 0.995
#: Vectors that the index is fitted on, at most, if EACH for a word are not more; words of a codebook, at most; vectors for a cell, about; members and askers of a block.
SAMPLE, WORDS, FILL, BLOCK = 20_000, 4096, 8, 1024
#: Of the sample, vectors for a word at least.
EACH = 32


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([distances(x[at : at + 4096], centre).argmin(1) for at in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None, :], 0)


class MultiIndex:
    """Codebooks of the two halves and the number of cells to visit."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int) -> None:
        self.first, self.second, self.visits = first, second, visits

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each row, nearest first, by multi-sequence traversal: in the grid of both halves' words by distance, the n-th cell has (row + 1) * (column + 1) <= n, so only those are compared."""
        half = self.first.shape[1]
        (d1, o1), (d2, o2) = (nearest(p, words, visits) for p, words in ((x[:, :half], self.first), (x[:, half:], self.second)))
        size = np.minimum(visits // (np.arange(d1.shape[1]) + 1), d2.shape[1])
        i = np.repeat(np.arange(d1.shape[1]), size)
        j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(d1[:, i] + d2[:, j], 1, kind="stable")[:, :visits]
        return np.take_along_axis(o1[:, i] * len(self.second) + o2[:, j], order, 1)

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, threshold: float, recall: float) -> MultiIndex:
        half = (x.shape[1] + 1) // 2
        k = words_for(rows)
        k1, k2 = (min(k, len(np.unique(h, axis=0))) for h in (x[:, :half], x[:, half:]))
        out = cls(kmeans(x[:, :half], k1), kmeans(x[:, half:], k2) if half < x.shape[1] else np.zeros((1, 0)), 1)
        cells = len(out.first) * len(out.second)
        some = x[:1000]
        noise = np.random.default_rng(9).standard_normal(some.shape)
        noise -= (noise * some).sum(1, keepdims=True) * some
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        other = threshold * some + np.sqrt(1 - threshold**2) * noise  # neighbours at the threshold, the hardest ones
        visits = 1
        while visits < cells:
            there = (out.cells(some, visits) == out.cells(other, 1)).any(1) | (out.cells(other, visits) == out.cells(some, 1)).any(1)
            if there.mean() >= recall:
                break
            visits = min(cells, visits + max(1, visits // 4))
        out.visits = visits
        return out


def words_for(rows: int) -> int:
    return int(np.clip(np.sqrt(rows / FILL), 1, WORDS))


def nearest(x: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the nearest words of each row, ``most`` at most, nearest first."""
    d = distances(x, words)
    n = min(most, len(words))
    near = np.sort(np.argpartition(d, n - 1, 1)[:, :n], 1)
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
    return np.take_along_axis(d, near, 1), near


def raw(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows of a with those of b reach the threshold, in extended precision."""
    a, b = ((x / np.abs(x).max(1, keepdims=True)).astype(np.longdouble) for x in (a.astype(np.longdouble), b.astype(np.longdouble)))
    return (a * b).sum(1) >= np.longdouble(threshold) * np.sqrt((a * a).sum(1) * (b * b).sum(1))


def vector(vectors: DataFrame, vec_col: str) -> Column:
    """The vectors' components, without negative zeros; floats stay floats."""
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    return F.transform(F.col(vec_col).cast(f"array<{kind}>"), lambda v: v + F.lit(0).cast(kind))


def can_link(vec_col: str) -> Column:
    return usable(vec_col) & F.coalesce(F.exists(F.col(vec_col).cast("array<double>"), lambda v: v != 0), F.lit(False))


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(x, rep, count) of the vectors that can link, equal ones together, with a number c and two hashes k and j of x."""
    rows = vectors.filter(can_link(vec_col)).select(F.col(id_col).alias("id"), vector(vectors, vec_col).alias("x"))
    rows = rows.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("count"))
    return materialize(rows.select("x", "rep", "count", F.size("x").alias("dim"), F.monotonically_increasing_id().alias("c"), *hashes("x")), "vectors")


def hashes(x: str | Column) -> tuple[Column, Column]:
    x = F.col(x) if isinstance(x, str) else x
    return F.xxhash64(x).alias("k"), F.xxhash64(F.lit(7), x).alias("j")


def linked(cl: DataFrame, dim: int, threshold: float, recall: float) -> DataFrame:
    """(u, v, links) for classes (c, x, count) of one length: links of class u in a block, v a neighbour in a spanning forest or null."""
    spark = cl.sparkSession
    rows = cl.count()
    sample = cl.orderBy(F.xxhash64("x"), "c").limit(max(SAMPLE, EACH * words_for(rows))).select("x").toArrow()["x"].combine_chunks()
    shared = spark.sparkContext.broadcast(MultiIndex.fit(unit(raw(sample, dim)), rows, threshold, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            if b.num_rows:
                x = unit(raw(b.column("x"), dim))
                cells = np.concatenate([index.cells(x[at : at + 256], index.visits) for at in range(0, len(x), 256)]).astype(np.int32)
                cells_ = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("c", "x", "count")), cells_], ["c", "x", "count", "cells"])

    cl = cl.select("c", "x", "count")
    placed = cl.mapInArrow(place, f"c bigint, x {dict(cl.dtypes)['x']}, count bigint, cells array<int>")
    placed = materialize(placed.withColumn("own", F.element_at("cells", 1)), "cells")
    fill = materialize(placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("fill")), "fill")  # at most WORDS ** 2 rows
    asks = placed.select("c", F.explode("cells").alias("cell"), F.lit(1).alias("asks"))
    asks = join_by_key(asks, fill, "cell")
    blocks = F.ceil(F.col("fill") / BLOCK).cast("int")
    members = join_by_key(placed.select("c", F.col("own").alias("cell")), fill, "cell")
    members = members.select("c", "cell", F.lit(0).alias("asks"), F.pmod(F.xxhash64("c"), blocks).cast("int").alias("b"))
    asks = asks.select("c", "cell", "asks", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"))
    both = members.unionByName(asks).join(placed, "c").withColumn("cells", F.when(F.col("asks") == 0, F.col("cells")))
    both = both.repartition("cell", "b").sortWithinPartitions("cell", "b", "asks", "c")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def meet(mx: pa.Table, m: np.ndarray, mcells: np.ndarray, ax: pa.Table) -> Iterator[tuple[int, int | None, int]]:
        mc, ac, a = mx["c"].to_numpy(), ax["c"].to_numpy(), raw(ax["x"].combine_chunks(), dim)
        near = unit(a) @ unit(m).T
        # members that ask the asker's cell too find the pair there as well: it counts where the smaller class asks
        row, col = np.nonzero((near >= threshold - 1e-9) & (ac[:, None] != mc[None, :]))
        keep = ~(mcells[col] == ax["own"].to_numpy()[row][:, None]).any(1) | (ac[row] < mc[col])
        row, col = row[keep], col[keep]
        edge = np.flatnonzero(near[row, col] < threshold + 1e-9)
        keep = np.ones(len(row), bool)
        keep[edge] = reach(a[row[edge]], m[col[edge]], threshold)
        row, col = row[keep], col[keep]
        if not len(row):
            return
        name, at = np.unique(np.concatenate([mc, ac]), return_inverse=True)
        u, v = at[len(mc) + row], at[col]
        weight = np.zeros(len(name))
        weight[at] = np.concatenate([mx["count"].to_numpy(), ax["count"].to_numpy()])
        links = np.bincount(u, weight[v], len(name)) + np.bincount(v, weight[u], len(name))
        use = np.unique(np.concatenate([u, v]))
        pos = np.full(len(name), -1)
        pos[use] = np.arange(len(use))
        matrix = np.zeros((len(use), len(use)), bool)
        matrix[pos[u], pos[v]] = matrix[pos[v], pos[u]] = True
        for k in use.tolist():
            yield int(name[k]), None, int(links[k])
        for x, y in forest(len(use), lambda x, left: left[matrix[x, left]]):
            yield int(name[use[x]]), int(name[use[y]]), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple[int, int | None, int]]:
            for _, g in groups(batches, ["cell", "b"]):
                n = int((g["asks"].to_numpy() == 0).sum())
                if not n:  # no member fell into this block
                    continue
                mx = g.slice(0, n)
                m, mcells = raw(mx["x"].combine_chunks(), dim), mx["cells"].combine_chunks().flatten().to_numpy().reshape(n, -1)
                for at in range(n, g.num_rows, BLOCK):
                    yield from meet(mx, m, mcells, g.slice(at, BLOCK))

        yield from batched(out(), schema)

    return both.select("cell", "b", "asks", "c", "x", "count", "own", "cells").mapInArrow(run, "u bigint, v bigint, links bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id and kept."""
    cl = classes(vectors, id_col, vec_col)
    links = None
    for (dim,) in cl.select("dim").distinct().orderBy("dim").collect():  # vectors of one table have one length, or a few
        part = materialize(linked(cl.filter(F.col("dim") == dim), dim, threshold, recall), "links")
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "u bigint, v bigint, links bigint")
    label = components(links.filter("v is not null").select("u", "v")).withColumnRenamed("node", "c")
    total = links.groupBy(F.col("u").alias("c")).agg(F.sum("links").alias("links"))
    cl = cl.select("c", "k", "j", "rep", "count").join(label, "c", "left").join(total, "c", "left").withColumn("label", F.coalesce("label", "c"))
    cl = materialize(cl, "vectors")
    best = cl.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    cl = join_hot(cl, best, "label", "size", cl.count())
    cl = materialize(cl.select("k", F.col("j").alias("same"), "component_id", "count", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vectors")
    able = can_link(vec_col)
    rows = vectors.filter(able).select(F.col(id_col).alias("id"), *hashes(vector(vectors, vec_col)))
    rows = join_hot(rows, cl, "k", "count", vectors.count()).filter("j = same").select("id", "n_links", "component_id")
    alone = vectors.filter(~able).select(F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"))
    rows = rows.unionByName(alone).withColumn("component_id", F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = vec_id AS kept
FROM embeddings JOIN r ON r.a = vec_id GROUP BY vec_id
"""
