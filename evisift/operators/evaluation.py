"""Token accounting, evaluation and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.functions.answers import final_score

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def token_totals(answers: DataFrame) -> DataFrame:
    """One row: the sums and question_count."""
    return answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS], F.count("*").alias("question_count"))


def usage_by_question(calls: DataFrame) -> DataFrame:
    return calls.groupBy("qid").agg(*[F.sum(c).alias(c) for c in TOKENS])


def parse_counts(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_type, n_units, n_docs): of each type, and of all of them with a null type; documents without units count there."""
    by = units.groupBy("unit_type").agg(F.count("*").alias("n_units"), F.count_distinct("doc_id").alias("n_docs"))
    every = units.agg(F.count("*").alias("n_units")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))  # a row each
    return by.unionByName(every.select(F.lit(None).cast("string").alias("unit_type"), "n_units", "n_docs"))


def answers_by_type(answers: DataFrame) -> DataFrame:
    return answers.groupBy("question_type").agg(F.count("*").alias("n"))


def summary_and_detail(answers: DataFrame) -> DataFrame:
    """The submission's rows: qid 'summary' with the totals, and the questions. place orders them, the summary first."""
    total = token_totals(answers).select(F.lit("summary").alias("qid"), F.lit("").alias("answer"), *TOKENS, F.lit(-1).cast("bigint").alias("place"))
    return total.unionByName(answers.select("qid", F.col("pred_answer").alias("answer"), *TOKENS, F.col("ord").cast("bigint").alias("place")))


def accuracy(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: n_gold, n_correct and accuracy, the share of the gold questions answered right; 0 without gold."""
    hits = gold.select("qid", "answer").join(answers.select("qid", "pred_answer"), "qid", "left")
    out = hits.agg(F.count_distinct("qid").alias("n_gold"), F.coalesce(F.sum((F.col("pred_answer") == F.col("answer")).cast("bigint")), F.lit(0)).alias("n_correct"))
    return out.withColumn("accuracy", F.when(F.col("n_gold") > 0, F.col("n_correct") / F.col("n_gold")).otherwise(F.lit(0.0)))


def wrong_cases(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers that differ from their gold answer; those without one are left out."""
    rows = answers.join(gold.select("qid", F.col("answer").alias("gold_answer")), "qid")
    return rows.filter(F.col("pred_answer") != F.col("gold_answer")).select("qid", "gold_answer", "pred_answer", F.lit("mismatch").alias("error_tag"), *[c for c in ("debug_meta",) if c in answers.columns])


def score(accuracy_: DataFrame, totals: DataFrame, budget: int = K.TOKEN_BUDGET) -> DataFrame:
    both = accuracy_.crossJoin(F.broadcast(totals))  # a row each
    return both.withColumn("score", final_score("accuracy", "total_tokens", budget))


def pending(questions: DataFrame, done: DataFrame, redo: str | None = None) -> DataFrame:
    """Questions without an answer yet; redo names one to be answered again."""
    if redo is not None:
        done = done.filter(F.col("qid") != redo)
    return questions.join(done.select("qid"), "qid", "left_anti")


def in_order(answers: DataFrame, order: DataFrame) -> DataFrame:
    """answers with ord, their questions' place; unknown ones come last."""
    return answers.join(order.select("qid", "ord"), "qid", "left").withColumn("ord", F.coalesce("ord", F.lit(10**9)))
