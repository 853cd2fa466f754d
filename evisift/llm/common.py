"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.storage import remove, store, unused

#: A table of at most so many rows may be broadcast; beyond that only its hot keys are.
BROADCAST_ROWS = 100_000
#: Rows of a key that one task may always take.
HOT = 256
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(columns: Iterable[str]) -> list[Column]:
    """Columns by names that may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def join_hot(rows: DataFrame, sums: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to sums (a row a key, never null), of which ``size`` is how many of the ``total`` rows have the key at least. Keys with more than a thousandth of total, or HOT, are 1,000 at most and are broadcast; each of the others fits a task easily and is shuffled. how: inner, left or left_semi."""
    limit = max(total // 1000, HOT)
    hot = F.broadcast(sums.filter(F.col(size) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(sums.filter(F.col(size) <= limit), key, how)
    return rows.join(hot, key, "left_semi" if how == "left_semi" else "inner").select(*quoted(cold.columns)).unionByName(cold)


def join_by_key(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """big joined to small (one row per key, written already; its other columns are new) by a key that may be null and may hold a third of big's rows. small is broadcast if it has at most BROADCAST_ROWS rows; else big's keys are counted and the hot ones broadcast."""
    right, size = unused([*big.columns, *small.columns], "key", "size")
    keyed = small.withColumnRenamed(key, right)
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(keyed), F.col(key).eqNullSafe(F.col(right)), "inner").drop(right)
    counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(size))
    found = small.filter(F.col(key).isNotNull()).join(counts, key)
    out = join_hot(big.filter(F.col(key).isNotNull()), found, key, size, big.count()).drop(size)
    one = small.filter(F.col(key).isNull()).drop(key)  # a row at most
    return out.select(*quoted(out.columns)).unionByName(big.filter(F.col(key).isNull()).crossJoin(F.broadcast(one)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The runs of rows that agree in the integer columns ``keys``, over rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for s, e in zip(cut, cut[1:], strict=False):
            now = tuple(k[s].tolist())
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that edges (u, v) lead to. Alternating large-star and small-star rounds; every round is a table in the shared folder, which goes when the next is written."""
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    e, path = store(edges.filter("u <> v").select(high, low).distinct(), "edges")
    spark, total, before = e.sparkSession, e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = join_hot(both, least, "u", "c", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, middle = store(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = join_hot(large, least, "u", "c", 2 * total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, after = store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, path)
        remove(spark, middle)
        e, path = new, after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("node")))
        before, total = now, now[0]
