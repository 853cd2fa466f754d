"""Domains: what makes up their units and how their questions are answered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.functions.text import contains_any, detect_regulatory_title, detect_title
from evisift.operators.retrieval import RetrieverSettings
from evisift.operators.sections import element_sections, metric_sections, regulatory_units, section_units, split_sections, with_positions


@dataclass(frozen=True)
class Prompts:
    judge: str = ""
    context: str = ""
    single: str = ""
    multiple: str = ""


@dataclass(frozen=True)
class Domain:
    name: str
    units: Callable[..., DataFrame]
    retriever: RetrieverSettings
    prompts: Prompts
    shown: int
    tries: int = 2
    rules: bool = False
    whole: bool = False  # one call a question instead of one an option
    regulatory: bool = False
    title_prefix: str = ""
    plain_fallback: bool = False  # prompts of its own for each kind of choice
    label: str = ""  # of its strategy, in a run's manifest


def _reports(docs: DataFrame, headed: bool = True) -> DataFrame:
    return section_units(split_sections(docs, max_chars=1000, headed=headed)).unionByName(section_units(metric_sections(docs), 1))


def _contracts(docs: DataFrame, headed: bool = True) -> DataFrame:
    return section_units(split_sections(docs, max_chars=900, headed=headed)).unionByName(section_units(element_sections(docs), 1))


def _insurance(docs: DataFrame, headed: bool = True) -> DataFrame:
    """Sections with a keyword come twice, both times as what the keyword makes them."""
    s = split_sections(docs, unit_type="clause_block", max_chars=900, headed=headed)
    named = contains_any("text", K.INSURANCE_KEYWORDS)
    s = s.withColumn("unit_type", F.when(named & contains_any("text", K.FORMULA_KEYWORDS), "formula_block").otherwise("clause_block"))
    return section_units(s).unionByName(section_units(s.filter(named), 1))


def _research(docs: DataFrame, headed: bool = True) -> DataFrame:
    """Sections with a keyword come again as conclusions, under the same id."""
    s = split_sections(docs, max_chars=1000, headed=headed)
    again = s.filter(contains_any("text", K.RESEARCH_KEYWORDS)).withColumn("unit_type", F.lit("conclusion_block"))
    return section_units(s).unionByName(section_units(again, 1))


# --- fixed values: the prompts' wording -------------------------------------
REGULATORY = Prompts(
    "你是金融法规问答助手。你只能依据给定证据判断选项真伪，不能使用常识补全。输出必须是 JSON。",
    "",
    "你是单选题裁决器。根据各选项判断摘要选出唯一最可能正确的字母，只输出 JSON。",
    "你是多选题复核器。根据各选项判断摘要挑出所有正确选项，只输出 JSON。",
)
REPORTS = Prompts(
    "你是财报问答助手。优先依据财务指标、年份和比较关系判断选项真伪。只能依据证据作答，输出必须是 JSON。",
    "请优先核对年份、同比、现金分红、研发占比等财务指标，不要只做模糊语义判断。",
    "你是财报单选题裁决器。根据各选项判断摘要，选出唯一最可能正确的字母，只输出 JSON。",
    "你是财报多选题复核器。根据各选项判断摘要，挑出所有正确选项，只输出 JSON。",
)
INSURANCE = Prompts(
    "你是保险条款问答助手。请根据给定证据直接判断最终答案，只能依据证据，输出必须是 JSON。",
    "这可能是计算/比较题，请优先核对公式、适用条件、现金价值、账户价值、已交保费、基本保额。",
)
RESEARCH = Prompts(
    "你是行业研报问答助手。你需要核对行业结论、数据、市场规模与趋势判断。请区分原文明示信息和推断信息，只能依据证据作答。",
    "如果题目涉及多个研报，请优先对齐每份研报中的对应结论或数据，不要让单一文档覆盖另一份文档。",
    "你是研报单选题裁决器。根据各选项与证据摘要，选出唯一最可能正确的选项，只输出 JSON。",
    "你是研报多选题复核器。根据各选项与证据摘要，选出所有正确选项，只输出 JSON。",
)
CONTRACTS = Prompts(
    "你是金融合同与募集说明书问答助手。请重点核对发行主体、金额、期限、评级、中介机构、信息披露承诺和权利义务条款，只能依据证据作答。",
    "如果题目涉及多个文档，请分别核对每份文档的发行要素或核心条款，再判断选项。",
    "你是合同单选题裁决器。根据各选项证据摘要，选出唯一正确选项，只输出 JSON。",
    "你是合同多选题复核器。根据各选项证据摘要，选出所有正确选项，只输出 JSON。",
)
# --- end of fixed values -----------------------------------------------------

DOMAINS = {
    d.name: d
    for d in (
        Domain("regulatory", regulatory_units, RetrieverSettings(6, titled=False, cap=6), REGULATORY, 6, tries=1, regulatory=True, plain_fallback=True, label="articles"),
        Domain("financial_reports", _reports, RetrieverSettings(6, {"metric_row": 1.8, "paragraph": 1.0}, True), REPORTS, 6, rules=True, label="metric rules"),
        Domain("insurance", _insurance, RetrieverSettings(4, {"formula_block": 1.8, "clause_block": 1.1}, True), INSURANCE, 4, whole=True, title_prefix="insurance_", label="whole question"),
        Domain("research", _research, RetrieverSettings(7, {"conclusion_block": 1.6, "paragraph": 1.0}, True), RESEARCH, 7, label="conclusions"),
        Domain("financial_contracts", _contracts, RetrieverSettings(7, {"element_block": 1.8, "paragraph": 1.0}, True), CONTRACTS, 7, label="elements"),
    )
}


def domain(name: str) -> Domain:
    if name not in DOMAINS:
        raise ValueError(f"unknown domain: {name}")
    return DOMAINS[name]


def domain_of_run(run_id: str) -> str:
    """The domain that a run's name begins with."""
    for name in sorted(DOMAINS, key=len, reverse=True):
        if run_id.startswith(name + "_"):
            return name
    raise ValueError(f"no domain in the run's name: {run_id}")


def titled(docs: DataFrame, d: Domain) -> DataFrame:
    """docs (doc_id, text, meta_title) with their title."""
    fallback = F.concat(F.lit(d.title_prefix), "doc_id")
    if d.regulatory:
        return docs.withColumn("title", F.when(F.coalesce(F.length("meta_title"), F.lit(0)) > 0, F.col("meta_title")).otherwise(detect_regulatory_title("text", fallback)))
    return docs.withColumn("title", detect_title("text", fallback))


def build_units(docs: DataFrame, d: Domain, **how: object) -> DataFrame:
    """Evidence units with positions of docs (doc_id, doc_seq, title, text). how: for the domain's units; headed=False takes each document as one section."""
    return with_positions(d.units(docs, **how), docs.select("doc_id", "doc_seq")).withColumn("domain", F.lit(d.name))
