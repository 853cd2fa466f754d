"""Decisions: numeric rules, prompts, judgements and composed answers, a row for each question and option."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.functions.answers import clean_answer, compose, format_hits, json_object, needs_fallback
from evisift.functions.text import best_number, contains_any, metric_key, strip, unit_quality
from evisift.operators.evaluation import TOKENS
from evisift.sources.model import Calling, Client, call_model

# --- fixed values: the prompts' wording -------------------------------------
ASK_LABEL = '请输出 JSON，格式为 {"label": true/false, "reasoning_summary": "...", "used_evidence_ids": [1,2]}。'
AGAIN_LABEL = '上一次输出不是合法 JSON。请只输出一个 JSON 对象，例如 {"label": true, "reasoning_summary": "...", "used_evidence_ids": [1]}。'
ASK_ANSWER = '输出格式：{"answer": "A"} 或 {"answer": "AC"}'
AGAIN_ANSWER = '上一次输出不是合法 JSON。请只输出一个 JSON 对象，例如 {"answer": "A"}。'
ASK_ONE, ASK_SOME = '输出格式：{"answer": "A"}', '输出格式：{"answer": "AC"}'
ASK_WHOLE = '请输出 JSON，格式为 {"answer": "A", "reasoning_summary": "..."} 或 {"answer": "AC", "reasoning_summary": "..."}。'
# --- end of fixed values -----------------------------------------------------

#: What a piece of evidence holds.
HIT = ("unit_id", "doc_id", "score", "title_path", "text", "metadata")


def options(questions: DataFrame) -> DataFrame:
    """A row for each question and option: its key, text and query."""
    rows = questions.select("*", F.explode("options").alias("option", "option_text"))
    return rows.withColumn("query_id", F.concat_ws("#", "qid", "option")).withColumn("query_text", F.concat_ws("\n", "question", "option_text"))


def best_units(units: DataFrame) -> DataFrame:
    """Of each document and metric the row that reads best: by quality, then length, the first of equals."""
    rows = units.filter("unit_type = 'metric_row'").withColumn("name", F.col("metadata.metric_name")).filter(F.length("name") > 0)
    rows = rows.withColumn("metric_key", F.coalesce(metric_key("name"), F.col("name")))
    order = F.row_number().over(Window.partitionBy("doc_id", "metric_key").orderBy(F.desc(unit_quality("text")), F.desc(F.length("text")), "pos"))
    return rows.withColumn("r", order).filter("r = 1").drop("r", "name").withColumn("value", best_number("text", "metric_key"))


def rule_labels(opts: DataFrame, units: DataFrame) -> DataFrame:
    """opts with rule_label, rule_reason and rule_evidence: the option's metric in the second document against the first. Null where the rule says nothing: no metric, fewer than two documents, no number, or no direction."""
    best = best_units(units).select("doc_id", "metric_key", "value", F.struct("unit_id", "doc_id", F.lit(K.RULE_SCORE).alias("score"), "title_path", "text", "metadata").alias("hit"))
    rows = opts.withColumn("metric_key", metric_key("option_text"))
    two = rows.filter(F.size("doc_ids") >= 2)
    for i in (0, 1):
        side = best.select(F.col("doc_id").alias(f"doc{i}"), "metric_key", F.col("value").alias(f"value{i}"), F.col("hit").alias(f"hit{i}"))
        two = two.withColumn(f"doc{i}", F.get("doc_ids", F.lit(i))).join(side, [f"doc{i}", "metric_key"])
    up, down = contains_any("option_text", K.GROWTH), contains_any("option_text", K.DECLINE)
    label = F.when(up, F.col("value1") > F.col("value0")).when(down, F.col("value1") < F.col("value0"))
    reason = F.concat(F.lit("规则比较到 "), F.col("metric_key"), F.lit(" 在两份报告中的候选值分别为 "), F.col("value0").cast("string"), F.lit(" 和 "), F.col("value1").cast("string"), F.lit("，据此判断选项为 "), F.when(label, "正确").otherwise("错误"), F.lit("。"))
    found = two.select("qid", "option", label.alias("rule_label"), F.when(label.isNotNull(), reason).alias("rule_reason"), F.when(label.isNotNull(), F.array("hit0", "hit1")).alias("rule_evidence"))
    return rows.join(found.filter(F.col("rule_label").isNotNull()), ["qid", "option"], "left")


def label_prompt(context: str, shown: int) -> Column:
    parts = [F.concat(F.lit("题目："), "question"), F.concat(F.lit("题型："), "answer_format"), F.concat(F.lit("选项 "), "option", F.lit("："), "option_text")]
    parts += [F.lit(context)] if context else []
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("证据：\n"), format_hits("hits", shown)), F.lit(ASK_LABEL))


def _asked(prompts: DataFrame, make_client: Calling | Callable[[], Client], keys: list[str], tries: int, again: str, good: Column, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replies to prompts (keys, system, user): asked again, with a remark, as long as ``good`` doesn't hold. Usage is summed over all calls. ``written`` stores each round's replies, so that no call is made twice."""
    out, left = None, prompts
    for attempt in range(tries):
        got = written(call_model(left, make_client, keys, attempt)).withColumn("payload", json_object("content")).withColumn("attempt", F.lit(attempt))
        out = got if out is None else out.unionByName(got)
        if attempt + 1 < tries:
            bad = got.filter(~F.coalesce(good, F.lit(False))).withColumn("broken", F.col("payload").isNull())
            left = prompts.join(bad.select(*keys, "broken"), keys).withColumn("user", F.when(F.col("broken"), F.concat(F.col("user"), F.lit("\n\n" + again))).otherwise(F.col("user")))
    last = F.max_by(F.struct("payload", "content"), "attempt")
    return out.groupBy(*keys).agg(last["payload"].alias("payload"), *[F.sum(c).alias(c) for c in TOKENS])


def judge_options(opts: DataFrame, make_client: Calling | Callable[[], Client], system: str, context: str, shown: int, tries: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """opts (with hits, and rule_label where there are rules) with label, reasoning and usage. Options that a rule has decided are not asked about. A reply that stays unreadable is an error."""
    ruled = F.col("rule_label").isNotNull() if "rule_label" in opts.columns else F.lit(False)
    ask = opts.filter(~ruled).select("qid", "option", F.lit(system).alias("system"), label_prompt(context, shown).alias("user"))
    got = _asked(ask, make_client, ["qid", "option"], tries, AGAIN_LABEL, F.col("payload").isNotNull(), written)
    checked = F.when(F.col("payload").isNull(), F.raise_error(F.concat(F.lit("no JSON object in the reply for "), "qid", F.lit("/"), "option"))).otherwise(F.coalesce("payload.label", F.lit(False)))
    got = got.select("qid", "option", checked.cast("boolean").alias("asked_label"), F.coalesce("payload.reasoning_summary", F.lit("")).alias("asked_reason"), *TOKENS)
    rows = opts.join(got, ["qid", "option"], "left")
    rule_label, rule_reason = (F.col(c) if c in opts.columns else F.lit(None) for c in ("rule_label", "rule_reason"))
    rows = rows.withColumn("label", F.coalesce(rule_label.cast("boolean"), "asked_label")).withColumn("reasoning_summary", F.coalesce(rule_reason.cast("string"), "asked_reason", F.lit("")))
    if "rule_evidence" in opts.columns:
        rows = rows.withColumn("evidence_items", F.slice(F.when(ruled, F.concat("rule_evidence", F.slice("hits", 1, 2))).otherwise(F.col("hits")), 1, 6))
    else:
        rows = rows.withColumn("evidence_items", F.col("hits"))
    return rows.select("qid", "option", "label", "reasoning_summary", "evidence_items", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in TOKENS])


def answers(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """A row for each question: option_labels, pred_answer by composition, whether it needs the fallback, evidence (three of each true option, else three of the first), reasons and usage."""
    rows = judged.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("option", "label", "reasoning_summary", "evidence_items"))).alias("o"), *[F.sum(c).alias(c) for c in TOKENS])
    true = F.transform(F.filter("o", lambda x: x["label"]), lambda x: x["option"])
    kept = F.flatten(F.transform(F.filter("o", lambda x: x["label"]), lambda x: F.slice(x["evidence_items"], 1, 3)))
    rows = rows.select(
        "qid",
        F.map_from_entries(F.transform("o", lambda x: F.struct(x["option"], x["label"]))).alias("option_labels"),
        true.alias("selected"),
        F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.get("o", F.lit(0))["evidence_items"], 1, 3)).alias("evidence_items"),
        F.array_join(F.transform("o", lambda x: F.concat(x["option"], F.lit(": "), x["reasoning_summary"])), " | ").alias("reasoning_summary"),
        F.to_json(F.transform("o", lambda x: F.struct(x["option"].alias("option"), x["label"].alias("label"), x["reasoning_summary"].alias("reasoning_summary"), x["evidence_items"].alias("evidence_items")))).alias("payloads"),
        *TOKENS,
    )
    out = questions.join(rows, "qid")
    return out.withColumn("pred_answer", compose("answer_format", "selected")).withColumn("fallback", needs_fallback("answer_format", "selected"))


def fall_back(composed: DataFrame, make_client: Calling | Callable[[], Client], single: str, multiple: str, tries: int, written: Callable[[DataFrame], DataFrame], plain: bool = False) -> DataFrame:
    """composed with the answers of questions that need the fallback asked for: the allowed letters of the reply, one of them for single choice, the first option if none. plain: prompts of their own for single and multiple choice, of a reply to single choice its first letter counts, and A stands if nothing is left."""
    allowed = F.array_sort(F.map_keys("options"))
    one = F.col("answer_format") == "mcq"
    kind = F.lit("") if plain else F.concat(F.lit("\n题型："), "answer_format")
    form = F.when(one, ASK_ONE).otherwise(ASK_SOME) if plain else F.lit(ASK_ANSWER)
    user = F.concat(F.lit("题目："), "question", kind, F.lit("\n选项摘要："), "payloads", F.lit("\n"), form)
    ask = composed.filter("fallback").select("qid", allowed.alias("allowed"), one.alias("one"), F.when(one, single).otherwise(multiple).alias("system"), user.alias("user"))
    good = F.coalesce("payload.answer", F.lit("")).rlike("[A-Za-z]")
    got = _asked(ask.select("qid", "system", "user"), make_client, ["qid"], tries, AGAIN_ANSWER, good, written)
    reply = F.coalesce("payload.answer", F.lit(""))
    if plain:
        reply = F.when(F.col("one"), F.substring(strip(reply), 1, 1)).otherwise(reply)
    got = got.join(ask.select("qid", "allowed", "one"), "qid").withColumn("cleaned", clean_answer(reply, "allowed"))
    none = F.lit("A") if plain else F.get("allowed", F.lit(0))
    got = got.select("qid", F.when(F.length("cleaned") > 0, F.col("cleaned")).otherwise(none).alias("asked"), *[F.col(c).alias(f"more_{c}") for c in TOKENS])
    out = composed.join(got, "qid", "left")
    answer = F.when(F.col("asked").isNull(), F.col("pred_answer")).when(F.col("answer_format") == "mcq", F.substring("asked", 1, 1)).otherwise(F.col("asked"))
    out = out.withColumn("pred_answer", answer)
    for c in TOKENS:
        out = out.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
    return out.drop("asked", "fallback", "selected", "payloads", *[f"more_{c}" for c in TOKENS])


def judge_whole(questions: DataFrame, make_client: Calling | Callable[[], Client], system: str, hint: str, shown: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """questions (with hits) answered by one call each; the labels follow from the answer. True-or-false answers are not forced to A or B."""
    lines = F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    hinted = F.when(contains_any(F.concat("type", "question"), K.CALCULATION_KEYWORDS), hint).otherwise("")
    user = F.concat(F.lit("题目："), "question", F.lit("\n题型："), "answer_format", F.lit("\n选项：\n"), lines, F.lit("\n\n"), hinted, F.lit("\n\n证据：\n"), format_hits("hits", shown), F.lit("\n\n" + ASK_WHOLE))
    got = written(call_model(questions.select("qid", F.lit(system).alias("system"), user.alias("user")), make_client, ["qid"])).withColumn("payload", json_object("content"))
    rows = questions.join(got.select("qid", "payload", *TOKENS), "qid")
    letters = F.filter(F.split(F.upper(F.trim(F.coalesce("payload.answer", F.lit("")))), ""), lambda x: F.array_contains(F.map_keys("options"), x))
    joined = F.array_join(letters, "")
    answer = F.when(F.col("answer_format") == "mcq", F.when(F.length(joined) > 0, F.substring(joined, 1, 1)).otherwise("A"))
    answer = answer.when(F.col("answer_format") == "multi", F.when(F.length(joined) > 0, F.array_join(F.array_sort(F.array_distinct(letters)), "")).otherwise("A")).otherwise(joined)
    rows = rows.withColumn("pred_answer", answer)
    labels = F.map_from_entries(F.transform(F.map_keys("options"), lambda k: F.struct(k, F.col("pred_answer").contains(k))))
    return rows.withColumn("option_labels", labels).withColumn("evidence_items", F.slice("hits", 1, 4)).withColumn("reasoning_summary", F.coalesce("payload.reasoning_summary", F.lit(""))).drop("payload", "hits")
