"""From questions and units to answers, and the retrieval traces that need no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.operators.decisions import HIT, answers, fall_back, judge_options, judge_whole, options, rule_labels
from evisift.operators.retrieval import search
from evisift.plans.domains import Domain
from evisift.sources.model import Calling, Client


def collected(found: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, hits): each query's hits as an array in order. A query has a handful."""
    hit = F.struct("rank", *HIT)
    rows = found.groupBy(query).agg(F.array_sort(F.collect_list(hit)).alias("h"))
    return rows.select(query, F.transform("h", lambda h: F.struct(*[h[c].alias(c) for c in HIT])).alias("hits"))


def with_hits(rows: DataFrame, units: DataFrame, d: Domain, postings: DataFrame | None = None) -> DataFrame:
    hits = collected(search(units, rows.select("query_id", "query_text", "doc_ids"), d.retriever, postings=postings))
    return rows.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(dict(hits.dtypes)["hits"])))


def asked_rows(questions: DataFrame, d: Domain) -> DataFrame:
    """A row for each search: an option, or the whole question with its options as JSON."""
    if not d.whole:
        return options(questions)
    return questions.withColumn("query_id", F.col("qid")).withColumn("query_text", F.concat_ws("\n", "question", F.to_json("options")))


def answer(questions: DataFrame, units: DataFrame, d: Domain, make_client: Calling | Callable[[], Client], written: Callable[[DataFrame], DataFrame], postings: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A row for each question: qid, domain, question_type, pred_answer, option_labels, evidence_items, reasoning_summary, usage, debug_meta. written stores a table and reads it again; postings: the units' index; rows: what with_hits() has found for the questions already, and for others."""
    rows = with_hits(asked_rows(questions, d), units, d, postings) if rows is None else rows.join(questions.select("qid"), "qid", "left_semi")
    if d.whole:
        out = judge_whole(rows, make_client, d.prompts.judge, d.prompts.context, d.shown, written)
    else:
        if d.rules:
            rows = rule_labels(rows, units)
        judged = judge_options(rows, make_client, d.prompts.judge, d.prompts.context, d.shown, d.tries, written)
        composed = answers(questions, judged)
        out = fall_back(composed, make_client, d.prompts.single, d.prompts.multiple, d.tries, written, d.plain_fallback)
    return out.select(
        "qid", F.lit(d.name).alias("domain"), F.col("answer_format").alias("question_type"), "pred_answer", "option_labels", "evidence_items", "reasoning_summary",
        "prompt_tokens", "completion_tokens", "total_tokens", F.struct("doc_ids", "type").alias("debug_meta"), *[c for c in ("ord",) if c in out.columns],
    )


def traces(questions: DataFrame, units: DataFrame, d: Domain, postings: DataFrame | None = None) -> DataFrame:
    """(domain, qid, searches): each question's searches with their settings and hits; in domains with rules also the metric and what the rule says."""
    rows = with_hits(asked_rows(questions, d), units, d, postings)
    fields = ["query_id", "query_text", "doc_ids", "hits"]
    if d.rules:
        rows = rule_labels(rows, units)
        fields += ["metric_key", "rule_label", "rule_reason"]
    settings = F.struct(F.lit(d.retriever.top_k).alias("top_k"), F.lit(d.retriever.ensure_per_doc).alias("ensure_per_doc"), F.lit(str(d.retriever.boosts)).alias("boosts"))
    out = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("searches"))
    return out.select(F.lit(d.name).alias("domain"), "qid", settings.alias("settings"), "searches")
