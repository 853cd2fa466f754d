"""Command line: ``python -m evisift.cli COMMAND ...`` over a folder of documents and question files.

parse     documents of a domain -> units (Parquet) and counts
index     units -> postings beside them, which answer and traces then read
answer    questions -> answers, evidence, submission, usage, by type, in batches; resumes a run
evaluate  answers against gold answers
traces    retrieval traces, without a model; of one domain, or of all below a folder
submission  where a run's submission is
migrate   a flat run's files into folders, or those of all runs below a folder
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from functools import partial

from pyarrow import ArrowInvalid
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evisift import sinks
from evisift.functions.text import timestamp_id
from evisift.operators.evaluation import accuracy, answers_by_type, in_order, parse_counts, pending, wrong_cases
from evisift.operators.retrieval import unit_index
from evisift.plans.answering import answer, asked_rows, traces, with_hits
from evisift.plans.domains import DOMAINS, build_units, domain, titled
from evisift.sources.config import model_settings, read_env
from evisift.sources.documents import listing, load_documents, manifest, read_gold, read_questions, referenced, referenced_ids
from evisift.sources.ledger import Ledger
from evisift.sources.model import Calling, Client, http_client
from evisift.storage import exists, finished, materialize, scope


#: Questions that are answered before the run is written again.
BATCH = 20


def parse_domain(spark: SparkSession, name: str, documents: str, questions: str | None, out: str) -> None:
    """Documents, units and how many there are of each."""
    d = domain(name)
    found = manifest(listing(spark, documents, name), d.regulatory)
    if questions:
        found = referenced(found, referenced_ids(read_questions(spark, questions)))
    docs = materialize(titled(load_documents(spark, found, documents), d), "documents")
    docs.write.mode("overwrite").parquet(f"{out}/documents")
    build_units(docs.select("doc_id", "doc_seq", "title", "text"), d).write.mode("overwrite").parquet(f"{out}/units")
    sinks.single_json(parse_counts(docs, spark.read.parquet(f"{out}/units")), f"{out}/counts.json")


def index_domain(spark: SparkSession, name: str, parsed: str) -> None:
    """The units' postings, beside them: questions then tokenise no unit."""
    unit_index(spark.read.parquet(f"{parsed}/units"), domain(name).retriever).write.mode("overwrite").parquet(f"{parsed}/index")


def kept_index(spark: SparkSession, parsed: str) -> DataFrame | None:
    return spark.read.parquet(f"{parsed}/index") if exists(spark, f"{parsed}/index") else None


def ledger_below(path: str) -> str | None:
    """Where a run keeps its calls, if that is a folder that tasks can write to from Python."""
    try:
        Ledger(path)
    except (ArrowInvalid, OSError):
        return None
    return path


def answer_batches(spark: SparkSession, asked: DataFrame, name: str, parsed: str, path: str, qid: str | None, make_client: Callable[[], Client], batch: int = BATCH) -> None:
    """Answers what isn't answered yet: all is searched at once, then a batch of questions at a time is asked and written before the next. Single calls are kept in a ledger beside the answers."""
    d, units, postings = domain(name), spark.read.parquet(f"{parsed}/units"), kept_index(spark, parsed)
    done = sinks.checkpoint(spark, path)
    todo = materialize(asked if done is None else pending(asked, done, qid), "todo")
    number = 0 if done is None else spark.read.parquet(path).agg(F.max("batch")).first()[0] + 1
    if todo.isEmpty():
        return
    calling = Calling(make_client, ledger_below(f"{path}_calls"), str(number) if qid and done is not None else "")
    rows = materialize(with_hits(asked_rows(todo, d), units, d, postings), "searched")
    last = -1
    while True:
        some = materialize(todo.filter(F.col("ord") > last).orderBy("ord").limit(batch), "batch")
        top = some.agg(F.max("ord")).first()[0]
        if top is None:
            return
        counted = Observation("batch")
        with scope():
            got = answer(some, units, d, calling, lambda t: materialize(t, "calls"), postings, rows)
            sinks.append_checkpoint(got.observe(counted, F.count("*").alias("questions"), F.sum("total_tokens").alias("total_tokens")), path, number)
        sinks.log_line(spark, f"{path}_log", {"batch": number} | counted.get)
        last, number = top, number + 1


def run_answers(spark: SparkSession, name: str, parsed: str, questions: str, split: str | None, out: str | None, qid: str | None, limit: int | None, env: str, make_client: Callable[[], Client] | None = None) -> str:
    """Answers a domain's questions into a run's folder, by default a new one named by domain, split and time; an existing one is resumed. Returns the folder."""
    settings = model_settings(read_env(env))
    if make_client is None:
        if settings is None:
            raise RuntimeError("LLM_MODEL, LLM_API_BASE and LLM_API_KEY are needed")
        make_client = partial(http_client, settings)
    if out is None:
        out = "runs/" + spark.range(1).select(timestamp_id(f"{name}_{(split or 'all').lower()}")).first()[0]
    asked = materialize(read_questions(spark, questions, split, qid, limit), "questions")
    root, _, run_id = out.rstrip("/").rpartition("/")
    path = f"{out}/outputs/debug/checkpoint"
    d = domain(name)
    sinks.run_layout(
        spark, root or ".", run_id, name, split or "", settings.public() if settings else None, plugin=d.name, strategy=d.label, question_count=asked.count(), qid=qid, limit=limit, resumed=finished(spark, path)
    )
    answer_batches(spark, asked, name, parsed, path, qid, make_client)
    order = read_questions(spark, questions, split)
    export(in_order(materialize(sinks.checkpoint(spark, path), "answers"), order), out)
    return out


def export(answers: DataFrame, base: str) -> None:
    sinks.write_answers(answers, f"{base}/outputs/debug/answers.json")
    sinks.write_evidence(answers, f"{base}/outputs/debug/evidence.json")
    sinks.write_submission(answers, f"{base}/outputs/submission/answer.csv")
    sinks.write_usage(answers, f"{base}/outputs/debug/token_usage.json")
    sinks.write_by_type(answers, f"{base}/outputs/by_type")


def evaluate(spark: SparkSession, run: str, gold: str | None) -> None:
    answers = sinks.checkpoint(spark, f"{run}/outputs/debug/checkpoint")
    sinks.single_json(answers_by_type(answers), f"{run}/analysis/answers_by_type.json")
    if gold:
        g = read_gold(spark, gold)
        sinks.single_json(accuracy(answers, g), f"{run}/analysis/metrics.json")
        wrong_cases(answers, g).write.mode("overwrite").json(f"{run}/analysis/wrong_cases")


def write_all_traces(spark: SparkSession, names: Sequence[str], parsed: str, questions: str, split: str | None, out: str) -> None:
    """Traces of several domains (their units below parsed, their questions below questions) as one table by domain, and its manifest."""
    every = None
    for name in names:
        got = traces(read_questions(spark, f"{questions}/{name}_questions.json", split), spark.read.parquet(f"{parsed}/{name}/units"), domain(name), kept_index(spark, f"{parsed}/{name}"))
        got = got.withColumn("searches", F.to_json("searches"))  # domains with rules have more fields
        every = got if every is None else every.unionByName(got)
    sinks.write_traces(every, out)
    sinks.write_manifest(spark, f"{out}/_manifest.json", {"split": split, "domains": list(names), "domain_files": {n: f"{out}/domain={n}" for n in names}, "combined_file": out})


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="evisift")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "parse": ("--domain", "--documents", "--questions?", "--out"),
        "index": ("--domain", "--parsed"),
        "answer": ("--domain", "--parsed", "--questions", "--split?", "--out?", "--qid?", "--limit?", "--env?"),
        "evaluate": ("--run", "--gold?"),
        "traces": ("--domain", "--parsed", "--questions", "--split?", "--out"),
        "submission": ("--run",),
        "migrate": ("--run?", "--runs?"),
    }.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("?"), required=not a.endswith("?"))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("evisift").getOrCreate()
    if a.command == "submission":
        print(sinks.submission_path(spark, a.run))
    elif a.command == "migrate":
        for old, new in sinks.migrate_layout(spark, a.run) if a.run else sinks.migrate_runs(spark, a.runs):
            print(old, "->", new)
    elif a.command == "parse":
        parse_domain(spark, a.domain, a.documents, a.questions, a.out)
    elif a.command == "index":
        index_domain(spark, a.domain, a.parsed)
    elif a.command == "answer":
        run_answers(spark, a.domain, a.parsed, a.questions, a.split, a.out, a.qid, int(a.limit) if a.limit else None, a.env or ".env")
    elif a.command == "evaluate":
        evaluate(spark, a.run, a.gold)
    elif a.domain == "all":
        write_all_traces(spark, list(DOMAINS), a.parsed, a.questions, a.split, a.out)
    else:
        units = spark.read.parquet(f"{a.parsed}/units")
        sinks.write_traces(traces(read_questions(spark, a.questions, a.split), units, domain(a.domain), kept_index(spark, a.parsed)), a.out)


if __name__ == "__main__":
    main()
