from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.operators import sections
from evisift.operators import sections as S
from evisift.plans.domains import DOMAINS, build_units, domain_of_run, titled


def docs(spark, text, title="T", doc_id="d"):
    return spark.createDataFrame([(doc_id, title, text, 1)], "doc_id string, title string, text string, doc_seq int")


def test_sections_and_pages(spark):
    text = "[PAGE 1]\n1 总则\n正文甲\n[PAGE 2]\n2 定义\n3 范围\n正文乙"
    got = [(r.section_id, r.title_path, r.text, r.page_refs) for r in S.split_sections(docs(spark, text)).orderBy("section_seq").collect()]
    assert got == [("sec_1", ["T", "1 总则"], "正文甲", [1, 2]), ("sec_2", ["T", "3 范围"], "正文乙", [])]


def regulation(body):
    return "\n".join(["序言", "第一章 总则", "第一条 为了规范", "本办法适用。", "第二条 标题", body, "第二章 附则", "第三条 只有标题", "第四条 施行", "自公布之日起施行。"])


def test_articles(spark):
    got = {r.unit_id: (r.title_path, r.text) for r in S.regulatory_units(docs(spark, regulation("本条正文。"), "办法X")).collect()}
    assert set(got) == {"d::preamble", "d::第一条", "d::第二条", "d::第四条"}
    assert got["d::第二条"] == (["办法X", "第二章 附则", "第二条"], "第二条 标题\n本条正文。")  # filed under the chapter that follows
    assert got["d::第一条"] == (["办法X", "第一章 总则", "第一条"], "第一条 为了规范\n本办法适用。")
    assert "d::第二条" not in {r.unit_id for r in S.regulatory_units(docs(spark, regulation("第二条正文。"), "办法X")).collect()}


def test_long_article_is_cut(spark):
    text = "第一条 甲\n" + "字" * 700 + "。" + "词" * 700 + "。"
    got = S.regulatory_units(docs(spark, text)).orderBy("chunk_seq").collect()
    assert [(r.unit_id, r.unit_type, r.parent_unit_id, r.metadata.chunk_index) for r in got] == [(f"d::第一条::chunk_{i}", "article_chunk", "d::第一条", i) for i in (1, 2)]


def test_windows(spark):
    lines = "l0\nl1\n营业收入 1 期限\nl3\nl4"
    metric, element = S.metric_sections(docs(spark, lines, doc_id="r2021")).first(), S.element_sections(docs(spark, lines)).first()
    assert metric.text == "l1\n营业收入 1 期限\nl3" and metric.metadata.year == "2021" and metric.metadata.numbers == ["1", "1", "3"]
    assert element.text == "l1\n营业收入 1 期限\nl3\nl4" and element.section_id == "element_3" and element.metadata.element_name == "期限"


def test_domain_units(spark):
    text = "产品条款\n1 责任\n身故保险金按账户价值给付\n2 其他\n无"
    d = spark.createDataFrame([("b", 2, text, ""), ("a", 1, "甲\n乙", "")], "doc_id string, doc_seq int, text string, meta_title string")
    ins = DOMAINS["insurance"]
    got = build_units(titled(d, ins), ins).orderBy("pos").collect()
    assert [(r.pos, r.unit_id, r.unit_type) for r in got] == [(0, "a::sec_1", "clause_block"), (1, "b::sec_1", "clause_block"), (2, "b::sec_2", "formula_block"), (3, "b::sec_3", "clause_block"), (4, "b::sec_2", "formula_block")]
    assert domain_of_run("financial_contracts_a_20260101_000000") == "financial_contracts"


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_long_documents_in_segments(spark, monkeypatch, segment):
    """Headings, pages, articles, chapters and windows of documents that are taken in segments are those of documents taken whole."""
    rng = random.Random(segment)
    lines = ["第一章 总则", "第二章 分则", "第一节 甲", "第1条 目的", "第2条", "一、概述", "正文。", f"{K.FINANCIAL_METRICS[0]} 5 元", f"{K.CONTRACT_KEYWORDS[0]} 7", "[PAGE 3]", "", "二、其他"]
    docs = spark.createDataFrame([(f"d{i}", i, "T", "\n".join(rng.choices(lines, k=rng.choice([0, 1, 12, 60])))) for i in range(12)] + [("e", 20, "T", None)], "doc_id string, doc_seq int, title string, text string")

    def everything():
        made = [sections.split_sections(docs), sections.metric_sections(docs), sections.element_sections(docs), sections.regulatory_units(docs, 40)]
        return [sorted(df.select(sorted(df.columns)).toJSON().collect()) for df in made]

    whole = everything()
    monkeypatch.setattr(sections, "LONG_TEXT", 30)
    monkeypatch.setattr(sections, "SEGMENT", segment)
    assert everything() == whole and all(whole)


def test_one_document_of_many_lines_uses_all_tasks(spark):
    """No task has more than a few segments of a document of 100,000 lines."""
    rows = spark.range(100_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("n"), (F.col("id") % 1000 == 0).alias("new"))
    got = sections.state(rows, 1 << 12, last={"at": F.when(F.col("new"), F.col("n"))}, sums={"g": F.col("new").cast("int")})
    assert got.filter("at <> n - n % 1000 OR g <> floor(n / 1000) + 1").count() == 0
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = sections.state(rows, 1 << 12, sums={"g": F.lit(1)}).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 60_000


def test_lines_that_begin_with_numbers_where_there_are_no_headings(spark):
    """A line such as a card's number in texts without headings stays text; one that is all there is makes a unit."""
    text = "一句。\n1219538112535716 Éaielletre.\n[PAGE 3]"
    d = spark.createDataFrame([("a", 1, "T", text), ("b", 2, "T", "2 只有")], "doc_id string, doc_seq int, title string, text string")
    for name in ("insurance", "research"):
        got = build_units(d, DOMAINS[name], headed=False).orderBy("pos").collect()
        assert [(r.pos, r.unit_id, r.text) for r in got] == [(0, "a::sec_1", text), (1, "b::sec_1", "2 只有")]


def test_every_window_of_segments_has_its_lines(spark, monkeypatch):
    """Windows of more lines than a segment has."""
    monkeypatch.setattr(sections, "LONG_TEXT", 3)
    monkeypatch.setattr(sections, "SEGMENT", 1)
    got = S.line_windows(docs(spark, "a\nb 期限\nc\nd\ne"), ["期限"], 1, 3).collect()
    assert [(r.n, r.window) for r in got] == [(1, "a\nb 期限\nc\nd\ne")]
