"""Questions as a stream: each micro-batch is answered and appended, a checkpoint folder remembers what was done. An addition of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evisift.sources.documents import QUESTION


def question_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(QUESTION).json(path, multiLine=True)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers every batch of new question files once and writes it under its number, so that a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        answer(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
