"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of numbers that one task may always sum.
SINGLE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all of Spark runs in this process, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="evisift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/evisift-{tag}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, on any file system that Spark knows."""
    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode("utf-8", "replace")))
    out.close()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder has a part file that a job has finished; one that broke off leaves none."""
    fs, where = file_system(spark, path)
    return fs.exists(where) and any(s.getPath().getName().startswith("part-") for s in fs.listStatus(where))


def one_file(lines: DataFrame, path: str, head: str = "", between: str = "", tail: str = "", order: Sequence[str] = ("place",), line: str = "line") -> None:
    """lines as one text file, in order, with ``between`` before all lines but the first; on any file system that Spark knows. The parts are written by Spark's tasks, joined as they are by the file system's client under another name, and renamed: a job that fails leaves no file, and no text passes through Python."""
    spark = lines.sparkSession
    nth, one = unused([*lines.columns], "nth", "one")
    if between:
        lines = running(lines.withColumn(one, F.lit(1)), [*order, line], {nth: one}).withColumn(line, F.concat(F.when(F.col(nth) > 0, F.lit(between)).otherwise(F.lit("")), line))
    parts, whole = f"{path}-parts-{uuid.uuid4().hex}", f"{path}-{uuid.uuid4().hex}"
    fs, target = file_system(spark, path)
    try:
        lines.orderBy(*order, line).select(line).write.text(parts)
        out = fs.create(file_system(spark, whole)[1], True)
        out.write(bytearray(head.encode()))
        names = sorted(s.getPath().toString() for s in fs.listStatus(file_system(spark, parts)[1]) if s.getPath().getName().startswith("part-"))
        for name in names:
            part = fs.open(file_system(spark, name)[1])
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, spark._jsc.hadoopConfiguration(), False)
            part.close()
        out.write(bytearray(tail.encode()))
        out.close()
        fs.delete(target, True)
        fs.rename(file_system(spark, whole)[1], target)
    finally:
        remove(spark, parts)
        remove(spark, whole)


#: Tables of the scopes that are open, the innermost last.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def _drop(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone already, and its folder with it
        return


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables that are written within go at its end, but for those that are materialized for the ``outer`` one. Nothing that reads them may be left."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _drop(spark, path)


def store(df: DataFrame, tag: str, outer: bool = False) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and where: the lineage is cut, and the loss of an executor costs nothing that is written. The files go with the scope (outer: with the one around it), without one when the driver's Python ends, or by remove() before."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    if len(_SCOPES) > outer:
        _SCOPES[-1 - outer].append((spark, path))
    else:
        atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str, outer: bool = False) -> DataFrame:
    return store(df, tag, outer)[0]


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is less than a full split for each and in fewer files than cores: files of one large row group would be read by one task. Other tables stay as they lie."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split and len(df.inputFiles()) < cores else df


def running(df: DataFrame, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """df with, for each name of ``values``, the sum of a column over the rows before, in an order that no two rows share. Beyond SINGLE rows ranges of the order are summed by themselves and then moved by the sums of the ranges before, of which there is a row a partition: no task sees all rows."""
    rows = materialize(df, "rows")
    if rows.count() <= SINGLE:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in values.items()])
    (part,) = unused([*df.columns, *values], "part")
    parts = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = parts.groupBy(part).agg(*[F.sum(c).alias(n) for n, c in values.items()])
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = unused([*df.columns, part, *values], *[f"{n}_base" for n in values])
    moved = sums.select(part, *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(b) for n, b in zip(values, base, strict=True)])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in values.items()]).join(F.broadcast(moved), part)
    for n, b in zip(values, base, strict=True):
        out = out.withColumn(n, F.col(n) + F.col(b))
    return out.drop(part, *base)
