from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evisift.functions import answers as A
from evisift.operators import evaluation as E
from evisift.operators.decisions import rule_labels
from evisift.operators.sections import metadata
from evisift.plans.answering import answer, traces
from evisift.plans.domains import DOMAINS, build_units, titled
from evisift.storage import materialize


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('```json\n{"label": true}\n```', (None, True)),
        ('{"label": tru, "answer": "bd"', ("BD", None)),
        ("answer is AC", ("AC", None)),
        ('{"label": "false"}', (None, True)),
        ('{"label": 0, "answer": "A"}', ("A", False)),
        ("nothing", None),
        (None, None),
    ],
)
def test_json_object(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "t string").select(A.json_object("t")).first()[0]
    assert (got and (got.answer, got.label)) == want


def test_compose(spark):
    cases = [("mcq", ["B"], "B", False), ("mcq", ["B", "A"], "A", True), ("multi", ["C", "A"], "AC", False), ("multi", [], "", True), ("tf", ["B"], "B", False), ("tf", ["A"], "A", False)]
    df = spark.createDataFrame([(k, s) for k, s, _, _ in cases], "k string, s array<string>")
    assert [tuple(r) for r in df.select(A.compose("k", "s"), A.needs_fallback("k", "s")).collect()] == [(a, f) for _, _, a, f in cases]


def test_evaluation(spark):
    answers = spark.createDataFrame([("q1", "A", "mcq"), ("q2", "B", "mcq"), ("q9", "C", "tf")], "qid string, pred_answer string, question_type string")
    gold = spark.createDataFrame([("q1", "A"), ("q2", "C"), ("q3", "D")], "qid string, answer string")
    assert E.accuracy(answers, gold).first().accuracy == pytest.approx(1 / 3)
    assert E.accuracy(answers, gold.limit(0)).first().accuracy == 0
    assert [r.qid for r in E.wrong_cases(answers, gold).collect()] == ["q2"]
    assert spark.range(1).select(A.final_score(F.lit(0.8), F.lit(251_616), 5_000_000)).first()[0] == pytest.approx(78.7922, abs=1e-4)
    assert [r.qid for r in E.pending(gold, answers, redo="q2").orderBy("qid").collect()] == ["q2", "q3"]


def test_rule(spark):
    u = spark.createDataFrame([("d1", 0, "营业收入 100 同比"), ("d2", 1, "营业收入 120 同比")], "doc_id string, pos long, text string")
    u = u.select("*", F.col("doc_id").alias("unit_id"), F.lit("metric_row").alias("unit_type"), F.array("doc_id").alias("title_path"), metadata(metric_name=F.lit("营业收入")).alias("metadata"))
    opts = spark.createDataFrame([("q", o, t, ["d1", "d2"]) for o, t in (("A", "营业收入较上年增长"), ("B", "营业收入较上年下降"), ("C", "营业收入稳定"), ("D", "增长"))], "qid string, option string, option_text string, doc_ids array<string>")
    assert [r.rule_label for r in rule_labels(opts, u).orderBy("option").collect()] == [True, False, None, None]


def stub():
    def ask(messages):
        text = messages[1]["content"]
        usage = {"prompt_tokens": 3, "completion_tokens": 1, "total_tokens": 4}
        if "选项摘要" in text:
            return json.dumps({"answer": "c"}), usage
        if "选项：\n" in text:
            return json.dumps({"answer": "BA", "reasoning_summary": "r"}), usage
        return json.dumps({"label": "选项 A：" in text, "reasoning_summary": "r"}), usage

    return ask


def questions(spark, rows):
    q = spark.createDataFrame(rows, "qid string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>")
    return q.withColumn("ord", F.col("qid"))


def test_answers_end_to_end(spark):
    text = "管理办法\n第一条 目的\n为了规范行为。\n第二条 范围\n适用于本行。"
    d = spark.createDataFrame([("r", 1, text, ""), ("s", 2, text, "")], "doc_id string, doc_seq int, text string, meta_title string")
    opts = {"A": "规范行为", "B": "适用于本行", "C": "无关"}
    q = questions(spark, [("1", "目的？", opts, "mcq", "x", ["r"]), ("2", "范围？", opts, "multi", "x", ["r", "s"]), ("3", "是否？", {"A": "规范", "B": "否"}, "tf", "x", ["s"])])
    for name, want in (("regulatory", ["A", "A", "A"]), ("insurance", ["B", "AB", "BA"]), ("research", ["A", "A", "A"])):
        dom = DOMAINS[name]
        units = materialize(build_units(titled(d, dom), dom), "units")
        got = answer(q, units, dom, stub, lambda t: materialize(t, "calls")).orderBy("qid").collect()
        assert [r.pred_answer for r in got] == want, name
        assert got[0].total_tokens == (4 if name == "insurance" else 12) and got[0].evidence_items
        assert traces(q, units, dom).count() == 3
