"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: tuple[int, int], id_col: str = "doc_id") -> DataFrame:
    """(id, text, y) of at most so many labelled documents of class 0 and of class 1 as ``most`` says, those with the smallest hash of the id, among the label rows of docs for which ``train`` holds. Null labels and ids are left out; an id whose label rows disagree gets the larger share, a tie 0; of texts that share an id the one with the smallest hash stands."""
    y = labels.filter(train & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    y = y.join(docs.select(id_col).hint("merge"), id_col, "left_semi")  # labels of other documents would use up the bound
    y = y.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("y"))
    y = y.withColumn("r", F.xxhash64("id"))
    few = [y.filter(F.col("y") == c).orderBy("r", "id").limit(most[c]) for c in (0, 1)]
    few = few[0].unionByName(few[1]).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(few), "id")  # most's sum of rows of an id and a label
    return texts.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "y")
