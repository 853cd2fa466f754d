"""Text expressions on literals worked out by hand."""

from __future__ import annotations

import html
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evisift.functions import text as T

BOM, WIDE = chr(0xFEFF), chr(0x3000)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


def test_tokens(spark):
    got = one(spark, "金融 第十二条 Rate 3.5% 税 End.", T.tokenize)
    assert got == ["rate", "3.5%", "end.", "金", "融", "金融", "第", "十", "二", "条", "第十", "十二", "二条", "税", "第十二条"]
    assert one(spark, "", T.tokenize) == []
    assert one(spark, f"ab{BOM}cd e", T.tokenize) == ["abcd", "e"]


def test_normalize(spark):
    assert one(spark, f"{BOM}a{WIDE} b\t\tc\n\n\n\nd ", T.normalize_whitespace) == "a b c\n\nd"
    assert one(spark, f"a\n\n{WIDE}\n b\r\nc", T.clean_lines) == ["a", "b", "c"]


def test_chunks(spark):
    assert one(spark, "aaa。bb。cccc。d。", lambda c: T.greedy_chunks(c, 6)) == ["aaa。", "bb。", "cccc。", "d。"]
    assert one(spark, "abcdefghij", lambda c: T.greedy_chunks(c, 6)) == ["abcdefghij"]


def plain_chunks(text, limit):
    if len(text) <= limit:
        return [text]
    out, held = [], ""
    for part in re.split(r"(?<=[。；！？\n])", text):
        if held and len(held) + len(part) > limit:
            out.append(held.strip())
            held = part
        else:
            held += part
    return out + ([held.strip()] if held.strip() else []) or [text]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab。；\n ", max_size=60))
def test_chunks_property(spark, text):
    assert one(spark, text, lambda c: T.greedy_chunks(c, 8)) == plain_chunks(text, 8)


def test_numbers(spark):
    assert one(spark, "营业收入 2023 1,500", T.best_number) == 2023.0
    assert one(spark, "none", T.best_number) is None
    assert one(spark, "1,234.5 v2.0.1 7", T.isolated_numbers) == [1234.5, 7.0]
    share = lambda c: T.best_number(c, F.lit("研发占比"))
    assert one(spark, "2023 5.2 7 900", share) == 7.0
    assert one(spark, "2023 900", share) == 900.0


def test_metric_order(spark):
    from evisift.functions.constants import FINANCIAL_METRICS

    assert one(spark, "研发投入占营业收入的比例 5.2%", lambda c: T.first_keyword(c, FINANCIAL_METRICS)) == "营业收入"
    assert one(spark, "末期股息 5", T.metric_key) == "现金分红"


def test_titles(spark):
    assert one(spark, "第一行\n《某某办法》 全文", lambda c: T.detect_title(c, F.lit("x"))) == "某某办法"
    assert one(spark, "甲\n年度报告\n乙", lambda c: T.detect_title(c, F.lit("x"))) == "年度报告"
    assert one(spark, " \n", lambda c: T.detect_title(c, F.lit("x"))) == "x"
    assert one(spark, "甲\n管理办法 \n乙", lambda c: T.detect_regulatory_title(c, F.lit("x"))) == "管理办法"


def test_headings(spark):
    for line, yes in (("1 总则", True), ("1.2 范围", True), ("第三章 附则", True), ("一、概述", True), ("正文", False), ("", False), ("2023 1,234", True)):
        assert one(spark, line, T.looks_like_heading) is yes


def test_paths_and_runs(spark):
    assert one(spark, "/a/b/doc.v1.txt", T.path_stem) == "doc.v1"
    assert one(spark, "/a/b/doc.PDF", T.path_suffix) == "pdf"
    assert one(spark, "financial_reports_a_20260101_120000", T.run_domain) == "financial_reports"
    assert one(spark, "financial_reports_a_20260101_120000", T.run_split) == "A"
    assert one(spark, "x 2019 y 2021", T.year_of) == "2019"


def html_of(spark, page):
    return T.with_html_text(spark.createDataFrame([(page, 1)], "nodes string, plain int"), "nodes", "text").first().text


def test_html(spark):
    page = '<!DOCTYPE html><html><head><meta name="ArticleTitle" content=" T "><style>x{}</style></head><body><p>A &amp;lt; b</p><script>1</script><p> c </p></body></html>'
    assert html_of(spark, page) == "A &lt; b\nc"
    assert one(spark, page, T.html_title) == "T"


def test_html_entities(spark):
    cases = {
        "caf&eacute; &#233; &#xE9; &#XE9; &euro;5": "café é é é €5",
        "&amp;eacute; &amp;#233; &amp;": "&eacute; &#233; &",
        "AT&T R&D a&b;": "AT&T R&D a&b;",
        "&copy 2020 &copy; &rsquo;&ndash;&hellip;": "© 2020 © ’–…",
        "&notin; &notit; &#128; &#0; x": "∉ ¬it; € \ufffd x",
        "a&nbsp;b &lt;p&gt; &quot;q&quot; &middot;": "a\xa0b <p> \"q\" ·",
        "": "",
    }
    for page, want in cases.items():
        assert html_of(spark, f"<p>{page}</p>") == want
    assert html_of(spark, None) is None


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["&", "amp;", "amp", "lt;", "#", "65;", "x41;", "eacute;", "copy", " ", "b", ";", "T"]), max_size=12))
def test_html_entities_property(spark, parts):
    text = "".join(parts)
    want = "\n".join(x for x in [re.sub("[ \t]+", " ", html.unescape(text)).strip()] if x)
    assert html_of(spark, f"<p>{text}</p>") == want


def test_text_that_may_have_headings(spark):
    for text, yes in (("a\n 1 x", True), ("第一条", True), ("a\u2028\ufeff 二、x", True), ("x [PAGE 1]", True), ("a 1 b\nc 第一条", False), ("", False)):
        assert one(spark, text, T.may_have_headings) is yes


PIECES = ["<p>", "</p>", '<p title="a>b">', "<a href=x>", "<b c='>'>", "<script>", "</script>", '<style a="b">', "</style>", "<noscript>", "</noscript>", "<!-- c -->", "<!-->", "<!-- > -- ! -->", '<?xml v="1" ?>', "<!DOCTYPE html>", "<![CDATA[ x ]]>", "text", "x < y", "a<3", "<", ">", '"', "'", "<br/>", "</ p>", "</>", '<img src="a"b>', '<p a = "1" b>', "if (a<b && c>d) {}", "</scriptx>", "<SCRIPT src=x>", "</SCRIPT >", "<p =x>", '<p "q>', "--", '<a\nb="\n">', "&amp;lt;", "&eacute;", " ", "\n", "<div/>", "<script/>", "<p it's>", "<title>a<b</title>"]


def test_html_as_the_parser_reads_it(spark):
    pages = ['<p title="a>b">x</p>', "a<script>let x = 1; // no end", "<![CDATA[ a ]]>b", '<?xml version="1.0"?><p>c</p>', "g<!-- c -->h", None, "", "<p " + "a=1 " * 5000 + ">z"]
    rng = random.Random(4)
    pages += ["".join(rng.choices(PIECES, k=rng.randint(1, 7))) for _ in range(3000)]
    rows = spark.createDataFrame([(p,) for p in pages], "page string")
    both = T.with_html_text(rows, "page", "text").withColumn("plain", F.array_join(T.clean_lines(T.parsed_html(F.col("page"))), "\n"))
    assert [tuple(r) for r in both.filter("NOT (text <=> plain)").limit(5).collect()] == []
    first = [r.text for r in T.with_html_text(rows.limit(5).coalesce(1), "page", "text").collect()]
    assert first[0] == "x" and first[1] == "a" and first[3:] == ["c", "gh"]
    nodes = rows.withColumn("nodes", T.html_nodes("page"))
    assert nodes.filter(T.odd_html("page", "nodes")).count() < 0.6 * len(pages)


def test_html_references_without_a_semicolon(spark):
    page = "<h1>a &amp;&amp b&amp</h1><p>&copy;&copy &am &#65;&#65 &amp;lt; & &eacute;&eacute</p>"
    df = spark.createDataFrame([(page,), ("<title>x&amp</title>y&quot;",)], "page string")
    got = [r.text for r in T.with_html_text(df, "page", "text", ended=True).collect()]
    assert got == ["a &&amp b&amp\n©&copy &am A&#65 &lt; & é&eacute", 'x&amp\ny"']


@pytest.mark.parametrize("make", [T.detect_title, T.detect_regulatory_title])
def test_titles_take_time_in_proportion_to_the_text(spark, make):
    """Lines are split once, and ideographs paired in one pass."""
    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("x "), i)))
    plan = spark.range(1).select(make(text, F.lit("f")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert one(spark, "金" * 3 + "a" + "融", T.tokenize) == ["a", "金", "金", "金", "金金", "金金", "融"]
