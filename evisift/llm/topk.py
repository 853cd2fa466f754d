"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of fixed size, each broadcast to all candidates. A
pass scores every candidate against the block and keeps, for every query, a
histogram of the scores in the range where its k-th one lies; summed over all
tasks it tells the one bin that holds the k-th score, which the next pass splits,
down to a single integer. A last pass gives what lies above that score and, of
those equal to it, the smallest ids. A task reports only the highest bins that
hold k scores, and at most k rows a query: no group of ties is gathered anywhere.

Vectors are floored to integers (floor(1024 * x), x in double). Where no score can
reach 2^53 they are multiplied in doubles, which is exact then; beyond that in 64-bit
integers, and where a score could pass 2^62 the job fails with an error instead of
giving wrong ones. Integer vectors are written once and read by every pass.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without id. A vector of another length than a query's is no candidate for it;
empty vectors score 0 with each other. Rows that repeat an id are rows of their own:
each is asked if one is, and each is a candidate for all rows but itself. Ties go to
the smaller id, then to the row written first. No queries, or an empty table, give an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.llm.common import table
from evisift.storage import materialize

K, SCALE = 10, 1024
#: Queries that are broadcast at once; bins of a histogram; candidates that are scored at once.
BLOCK, BINS, ROWS = 2048, 4096, 512


def usable(vec: str = "embedding") -> Column:
    """Whether a vector takes part."""
    ok = F.forall(F.col(vec).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vec).isNotNull() & F.coalesce(ok, F.lit(False))


def integers(vec: str = "embedding", scale: int = SCALE) -> Column:
    return F.transform(F.col(vec).cast("array<double>"), lambda x: F.floor(x * scale))


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have dim components, as a matrix, and which they are."""
    size = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(size == dim)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[rows]
    return (flat[start[:, None] + np.arange(dim)] if len(rows) and dim else np.zeros((len(rows), dim))), rows


def scored(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, scores by query) of blocks of candidates. The type of q, double or 64-bit integer, is that of the products."""
    for b in batches:
        x, rows = matrix(b.column("x"), q.shape[1])
        row, ids = (b.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("row", "id"))
        for at in range(0, len(ids), ROWS):
            yield row[at : at + ROWS], ids[at : at + ROWS], q @ x[at : at + ROWS].astype(q.dtype).T


def histogram_pass(cands: DataFrame, block, k: int) -> DataFrame:  # noqa: ANN001
    """(q, bin, n): the highest bins of each task's scores in every query's range; bin BINS is all above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, low, width = block.value
        total = np.zeros((len(own), BINS + 1), np.int64)
        for got, _, s in scored(batches, q):
            at = np.floor_divide(s - low[:, None], width[:, None])
            at = np.where((at < 0) | (got[None, :] == own[:, None]), -1, np.minimum(at, BINS)).astype(np.int64)
            row, col = np.nonzero(at >= 0)
            np.add.at(total, (row, at[row, col]), 1)
        above = np.cumsum(total[:, ::-1], 1)[:, ::-1] - total
        row, col = np.nonzero((total > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(total[row, col])], ["q", "bin", "n"])

    return cands.mapInArrow(run, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def kth_scores(cands: DataFrame, own: np.ndarray, q: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of every query, or the least one if there are fewer. high: no score of the query is beyond it or below its opposite."""
    sc = cands.sparkSession.sparkContext
    low, width = -high, -(-(2 * high + 1) // BINS)
    while True:
        shared = sc.broadcast((own, q, low, width))
        got = histogram_pass(cands, shared, k).toPandas()  # at most k bins a query of the block
        shared.unpersist()
        count = np.zeros((len(own), BINS + 1), np.int64)
        count[got["q"], got["bin"]] = got["n"]
        above = np.cumsum(count[:, ::-1], 1)[:, ::-1]
        bin_ = np.where((above >= k).any(1), BINS - np.argmax((above >= k)[:, ::-1], 1), 0)
        low = low + np.minimum(bin_, BINS - 1).astype(low.dtype) * width
        if (width == 1).all():
            return low
        width = -(-width // BINS)


def last_pass(cands: DataFrame, block, k: int) -> DataFrame:  # noqa: ANN001
    """(query, query_id, row, vec_id, score): what is above the k-th score and, of those equal to it, the k smallest ids of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, q, kth = block.value
        found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, q.dtype))
        for got, vec, s in scored(batches, q):
            row, col = np.nonzero((s >= kth[:, None]) & (got[None, :] != own[:, None]))
            found = tuple(np.append(x, y) for x, y in zip(found, (row, got[col], vec[col], s[row, col]), strict=True))
            if len(found[0]) > 4 * k * len(own):
                found = best(*found, k)
        rows, got, vec, s = best(*found, k)
        yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(ids[rows]), pa.array(got), pa.array(vec), pa.array(s.astype(np.int64))], ["query", "query_id", "row", "vec_id", "score"])

    return cands.mapInArrow(run, "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint")


def best(rows: np.ndarray, got: np.ndarray, vecs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row the k highest scores, ties by id."""
    order = np.lexsort((got, vecs, -scores, rows))
    rows, got, vecs, scores = rows[order], got[order], vecs[order], scores[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], got[first], vecs[first], scores[first]


def bounds(q: np.ndarray, most: float) -> np.ndarray:
    """What no score of each query passes, by Cauchy and Schwarz; in the type in which its products are exact."""
    high = np.floor(np.linalg.norm(q.astype(np.float64), axis=1) * most * (1 + 1e-9)) + 1
    if (high >= 2.0**62).any():
        raise ValueError("vectors are too large: a score could leave the range of 64-bit integers")
    return high if (high < 2.0**52).all() else high.astype(np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the highest integer inner products; queries says which rows are the queries."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vec_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), integers(vec_col, scale).alias("x"), F.coalesce(queries, F.lit(False)).alias("asked"))
    cands = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "integers")
    asked = cands.filter("asked").withColumn("dim", F.size("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    most = cands.agg(F.max(norm)).first()[0] or 0.0
    cands = cands.select("row", "id", "x")
    out = []
    for (dim,) in asked.select("dim").distinct().orderBy("dim").collect():
        last = None
        while True:  # a block after the other, in the order of rows
            more = asked.filter(F.col("dim") == dim)
            more = (more if last is None else more.filter(F.col("row") > last)).orderBy("row").limit(BLOCK).toPandas()
            if not len(more):
                break
            own, ids = more["row"].to_numpy(), more["id"].to_numpy()
            q = np.vstack(more["x"].to_numpy()).reshape(len(more), dim).astype(np.int64)
            last, high = int(own[-1]), bounds(q, most)
            q = q.astype(high.dtype)
            kth = kth_scores(cands, own, q, high, k)
            shared = spark.sparkContext.broadcast((own, ids, q, kth))
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
            found = last_pass(cands, shared, k).withColumn("rank", rank).filter(F.col("rank") <= k)
            out.append(materialize(found.select("query_id", "rank", "vec_id", "score"), "topk"))
            shared.unpersist()
    if not out:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
