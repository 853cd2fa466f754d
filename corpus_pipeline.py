"""A training-data pipeline over ``documents``: quality, toxicity, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of their docs, whatever these are named. Null and empty texts pass the
classifiers as their scores say, stay apart in the near-duplicate stage and count
no words in the mix; very long texts are treated whole; of rows that repeat an id or a text one row of each near-duplicate class stays. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evisift.llm import mixing, near_duplicates, quality, toxicity, wfst
from evisift.llm.common import quoted, table
from evisift.storage import materialize, scope, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    (score,) = unused(docs.columns, "score")
    scored = quality.with_quality(docs, table(spark, sf_dir, "labels"), score)
    return scored.filter(quality.predicted(score) == 1).select(*quoted(docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    (score,) = unused(docs.columns, "score")
    scored = toxicity.with_toxicity(docs, table(spark, sf_dir, "labels"), score)
    return scored.filter(toxicity.predicted(score) == 0).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip."""
    return wfst.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece encoding and decoding", encode),
]

#: Classifiers trained in numpy can't be expressed in SQL: the tests hold run() against a plain version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope():  # a stage's own tables go when its result is written
            docs = materialize(stage(spark, docs, sf_dir), "stage", outer=True)
    return docs
