"""Sinks: answers, evidence, submissions, usage and a run's layout."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.operators.evaluation import TOKENS, summary_and_detail, token_totals
from evisift.storage import exists, file_system, finished, one_file, write_text

FOLDERS = ("meta", "outputs/submission", "outputs/debug", "outputs/by_type", "analysis")


def evidence_records(answers: DataFrame) -> DataFrame:
    """The evidence chain of each answer."""
    usage = F.struct(*TOKENS).alias("token_usage")
    return answers.select("qid", "pred_answer", "question_type", "option_labels", "reasoning_summary", "evidence_items", usage, "debug_meta")


def json_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_answers(answers: DataFrame, path: str) -> None:
    """One JSON file: an array of the answers, in order."""
    rows = answers.select(F.col("ord").alias("place"), json_line(*[c for c in answers.columns if c != "ord"]).alias("line"))
    one_file(rows, path, "[\n", ",", "]\n")


def evidence_map(answers: DataFrame) -> DataFrame:
    """(qid, evidence): each answer's evidence chain as JSON, under its question."""
    rows = evidence_records(answers)
    return rows.select("qid", F.to_json(F.struct(*[c for c in rows.columns if c != "qid"])).alias("evidence"))


def write_evidence(answers: DataFrame, path: str) -> None:
    """One JSON file: an object that has each question's evidence chain under its id."""
    rows = evidence_map(answers).join(answers.select("qid", F.col("ord").alias("place")), "qid")
    name = F.regexp_replace(F.to_json(F.array("qid")), r"^\[|\]$", "")
    one_file(rows.select("place", F.concat(name, F.lit(": "), "evidence").alias("line")), path, "{\n", ",", "}\n")


def write_submission(answers: DataFrame, path: str) -> None:
    """One CSV file with a header, the summary row first."""
    rows = summary_and_detail(answers)
    names = [c for c in rows.columns if c != "place"]
    one_file(rows.select("place", F.to_csv(F.struct(*names), {"emptyValue": ""}).alias("line")), path, ",".join(names) + "\n")


def write_by_type(answers: DataFrame, path: str) -> None:
    """Answers, evidence and ids, in a folder for each question type."""
    answers.withColumn("type", F.col("question_type")).write.mode("overwrite").partitionBy("type").json(f"{path}/answers")
    evidence_records(answers).withColumn("type", F.col("question_type")).write.mode("overwrite").partitionBy("type").json(f"{path}/evidence")
    answers.select(F.col("qid").alias("value"), F.col("question_type").alias("type")).write.mode("overwrite").partitionBy("type").text(f"{path}/qids")


def write_usage(answers: DataFrame, path: str) -> None:
    """One JSON file: an object of the sums."""
    write_text(answers.sparkSession, path, json.dumps(token_totals(answers).first().asDict(), indent=2))


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("overwrite").partitionBy("domain").json(path)


def append_checkpoint(answers: DataFrame, path: str, batch: int) -> None:
    """What is answered so far, a batch at a time; checkpoint() reads it."""
    answers.drop("ord").withColumn("batch", F.lit(batch).cast("bigint")).write.mode("append").parquet(path)


def checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """The last answer to each question, or None if there is none yet, or only what a broken write has left. path: on any file system that Spark knows."""
    if not finished(spark, path):
        return None
    rows = spark.read.parquet(path)
    last = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("batch")))
    return rows.withColumn("last", last).filter(F.col("last") == 1).drop("last", "batch")


def log_line(spark: SparkSession, path: str, record: dict) -> None:
    """One more record of a run's log: a file of one JSON line below path, as not every file system can append."""
    write_text(spark, f"{path}/{datetime.now(UTC):%Y%m%dT%H%M%S%f}.jsonl", json.dumps(record, ensure_ascii=False) + "\n")


def single_json(df: DataFrame, path: str) -> None:
    """A result of a few rows as one readable JSON file."""
    rows = [json.loads(r) for r in df.toJSON().collect()]
    write_text(df.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2))


def write_manifest(spark: SparkSession, path: str, record: dict) -> None:
    write_text(spark, path, json.dumps(record, ensure_ascii=False, indent=2))


def run_layout(spark: SparkSession, root: str, run_id: str, domain: str, split: str, settings: dict | None = None, **about: object) -> str:
    """A run's manifest and README; settings must hold no secrets. about: plugin, strategy, question_count, qid, limit, resumed. Folders come with their files."""
    base = f"{root.rstrip('/')}/{run_id}"
    record = {"run_id": run_id, "domain": domain, "split": split, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "folders": list(FOLDERS), "model": settings or {}} | about
    write_text(spark, f"{base}/meta/run_manifest.json", json.dumps(record, ensure_ascii=False, indent=2))
    write_text(spark, f"{base}/README.md", f"# Run {run_id}\n\nDomain {domain}, split {split}. Submission, debug and by-type outputs are below outputs/, evaluation below analysis/.\n")
    return base


def submission_path(spark: SparkSession, run: str) -> str:
    """The submission of a run, in its own folder or, in older runs, at the top. run: on any file system that Spark knows."""
    for p in (f"{run.rstrip('/')}/outputs/submission/answer.csv", f"{run.rstrip('/')}/answer.csv"):
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"no submission in {run}")


#: Files of a flat run, and the folders that they belong to.
MOVES = {"answer.csv": "outputs/submission", "answers.json": "outputs/debug", "evidence.json": "outputs/debug", "token_usage.json": "outputs/debug", "logs.jsonl": "outputs/debug", "metrics.json": "analysis", "wrong_cases.json": "analysis", "run_config.json": "meta"}


def migrate_layout(spark: SparkSession, run: str) -> list[tuple[str, str]]:
    """Moves the files of a flat run into the folders, and deals its answers to a file for each question type; what is there already stays. run: on any file system that Spark knows."""
    done, run = [], run.rstrip("/")
    fs, _ = file_system(spark, run)
    path = lambda name: file_system(spark, f"{run}/{name}")[1]
    for name, folder in MOVES.items():
        if fs.exists(path(name)) and not fs.exists(path(f"{folder}/{name}")):
            fs.mkdirs(path(folder))
            if not fs.rename(path(name), path(f"{folder}/{name}")):
                raise OSError(f"{run}/{name} could not be moved to {folder}")
            done.append((f"{run}/{name}", f"{run}/{folder}/{name}"))
    answers = f"{run}/outputs/debug/answers.json"
    if exists(spark, answers):
        rows = spark.read.text(answers, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "line"))
        rows = rows.withColumn("kind", F.coalesce(F.get_json_object("line", "$.question_type"), F.lit("unknown")))
        for r in rows.select("kind").distinct().orderBy("kind").collect():  # the types of questions
            new = f"outputs/by_type/{r.kind}/answers.json"
            if not fs.exists(path(new)):
                one_file(rows.filter(F.col("kind") == r.kind), f"{run}/{new}", "[\n", ",", "]\n")
                done.append((answers, f"{run}/{new}"))
    return done


def migrate_runs(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """migrate_layout of every run below root."""
    fs, where = file_system(spark, root)
    runs = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory())
    return [move for run in runs for move in migrate_layout(spark, run)]
