"""Patterns, word lists and parameters that results depend on."""

from __future__ import annotations

# --- fixed values ---------------------------------------------------------
K1, B = 1.5, 0.75
NEIGHBOUR_DECAY, NEIGHBOUR_FLOOR = 0.1, 0.01

HEADINGS = (
    r"^\p{Nd}+(\.\p{Nd}+){0,3}\s+.+$",
    r"^第[一二三四五六七八九十百零〇两\p{Nd}]+[章节条]\s*.*$",
    r"^[一二三四五六七八九十]+[、.].+$",
)
ARTICLE = r"^(第[一二三四五六七八九十百零〇两\p{Nd}]+条)\s*(.*)$"
CHAPTER = r"^(第[一二三四五六七八九十百零〇两\p{Nd}]+章)\s*(.*)$"
SECTION = r"^(第[一二三四五六七八九十百零〇两\p{Nd}]+节)\s*(.*)$"
NUMBERED = r"第[一二三四五六七八九十百零〇两\p{Nd}]+[章节条]"
ASCII_TOKEN = r"[a-z0-9_.%]+"
CJK_RUN = f"[{chr(0x4E00)}-{chr(0x9FFF)}]+"
NUMBER = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
ISOLATED_NUMBER = r"(?<![\p{Nd}.])(\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?)(?![\p{Nd}.])"

TITLE_KEYWORDS = ("报告", "办法", "合同", "条款", "说明书", "研究", "保险", "债券")
REGULATORY_TITLE_KEYWORDS = ("办法", "法", "指引", "准则")
FINANCIAL_METRICS = (
    "营业收入", "营业总收入", "归属于上市公司股东的净利润", "归母净利润", "经营活动产生的现金流量净额",
    "研发投入", "研发投入占营业收入的比例", "每10股派", "现金分红", "分红比例",
)
METRIC_ALIASES = (
    ("研发占比", ("研发投入占营业收入的比例",)),
    ("现金分红", ("每10股派", "现金分红", "末期股息")),
    ("营业收入", ("营业收入", "营业总收入", "营业额")),
    ("归母净利润", ("归属于上市公司股东的净利润", "归母净利润", "母公司拥有人应占溢利")),
    ("经营现金流", ("经营活动产生的现金流量净额",)),
    ("研发投入", ("研发投入",)),
)
PERCENT_METRIC = "研发占比"
GROWTH, DECLINE = ("增长", "高于", "优于", "提升"), ("下降", "低于", "减少", "下滑")
CONTRACT_KEYWORDS = ("发行人", "发行金额", "主体信用评级", "债项信用评级", "受托管理人", "主承销商", "期限", "利率", "回售", "赎回", "偿付", "违约")
INSURANCE_KEYWORDS = ("保险责任", "身故保险金", "现金价值", "账户价值", "已交保费", "基本保额", "退保", "领取", "年金")
FORMULA_KEYWORDS = ("账户价值", "已交保费", "基本保额")
RESEARCH_KEYWORDS = ("预计", "同比", "市场规模", "渗透率", "增速", "结论", "判断", "投资建议")
CALCULATION_KEYWORDS = ("计算", "推理", "比较", "多少")
#: Points of a metric row for words that it has.
ROW_POINTS = (("同比", 3), ("元）", 2), ("占营业收入比例", 2))
#: Fields of a reply that is no valid JSON.
REPLY_ANSWER = r'(?i)"answer"\s*:\s*"([A-D]+)"'
REPLY_LABEL = r'(?i)"label"\s*:\s*(true|false)'
REPLY_REASON = r'(?s)"reasoning_summary"\s*:\s*"([^"]*)"'
REPLY_IDS = r'(?s)"used_evidence_ids"\s*:\s*\[([^\]]*)\]'
REPLY_LETTERS = r"\b([A-D]{1,4})\b"
REPLY_FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
REPLY_BRACES = r"(?s)(\{.*\})"
TOKEN_BUDGET = 5_000_000
RULE_SCORE = 999.0
# --- end of fixed values --------------------------------------------------
