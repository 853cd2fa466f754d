"""Answers and model replies: reading JSON that may be broken, cleaning and composing answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.functions.text import col, strip

PAYLOAD = "struct<answer:string,label:boolean,reasoning_summary:string,used_evidence_ids:array<int>>"


def truthy(raw: Column) -> Column:
    """Whether a JSON value, given as its text, counts as true: everything but false, null, zero and what is empty; the string "false" is true."""
    return F.when(raw.isNull(), F.lit(None).cast("boolean")).otherwise(~raw.isin("false", "null", "0", "0.0", "", '""', "[]", "{}"))


def _repaired(c: Column) -> Column:
    answer, label = F.upper(F.regexp_extract(c, K.REPLY_ANSWER, 1)), F.lower(F.regexp_extract(c, K.REPLY_LABEL, 1))
    reason, ids = (F.regexp_extract(c, p, 1) for p in (K.REPLY_REASON, K.REPLY_IDS))
    has_reason, has_ids = (c.rlike(p) for p in (K.REPLY_REASON, K.REPLY_IDS))
    some = (answer != "") | (label != "") | has_reason | has_ids
    loose = F.regexp_extract(c, K.REPLY_LETTERS, 1)
    numbers = F.transform(F.filter(F.transform(F.split(ids, ","), strip), lambda x: x.rlike(r"\A\p{Nd}+\z")), lambda x: x.cast("int"))
    found = F.struct(
        F.when(answer != "", answer).alias("answer"),
        F.when(label != "", label == "true").alias("label"),
        F.when(has_reason, strip(reason)).alias("reasoning_summary"),
        F.when(has_ids, numbers).alias("used_evidence_ids"),
    ).cast(PAYLOAD)
    only = F.struct(loose.alias("answer"), F.lit(None).alias("label"), F.lit(None).alias("reasoning_summary"), F.lit(None).alias("used_evidence_ids")).cast(PAYLOAD)
    return F.when(some, found).when(loose != "", only)


def json_object(c: Column | str) -> Column:
    """PAYLOAD of the object in a reply: of a fenced block if there is one, between the outermost braces, else whatever patterns find; null if nothing is found."""
    c = col(c)
    fenced = F.regexp_extract(c, K.REPLY_FENCED, 1)
    candidate = F.when(fenced != "", fenced).otherwise(c)
    braces = F.regexp_extract(candidate, K.REPLY_BRACES, 1)
    valid = F.try_parse_json(braces)

    def text(path: str) -> Column:
        return F.try_variant_get(valid, path, "string")

    raw = text("$.label")
    is_text = F.schema_of_variant(F.try_variant_get(valid, "$.label", "variant")) == "STRING"
    label = F.when(F.coalesce(is_text, F.lit(False)), F.length(raw) > 0).otherwise(truthy(raw))
    parsed = F.struct(text("$.answer").alias("answer"), label.alias("label"), strip(text("$.reasoning_summary")).alias("reasoning_summary"), F.from_json(text("$.used_evidence_ids"), "array<int>").alias("used_evidence_ids")).cast(PAYLOAD)
    return F.when((braces != "") & valid.isNotNull(), parsed).otherwise(F.when(braces != "", _repaired(braces)).otherwise(_repaired(candidate)))


def clean_answer(answer: Column | str, allowed: Column | str) -> Column:
    """The allowed letters of an answer in upper case, sorted, each once."""
    letters = F.array_distinct(F.array_sort(F.split(F.upper(strip(answer)), "")))
    return F.array_join(F.filter(letters, lambda x: F.array_contains(col(allowed), x)), "")


def compose(kind: Column | str, selected: Column | str) -> Column:
    """The answer that the true options make: true-or-false A or B, single choice the first or A, multiple choice all of them."""
    kind, selected = col(kind), F.array_sort(col(selected))
    return F.when(kind == "tf", F.when(F.array_contains(selected, "A"), "A").otherwise("B")).when(kind == "mcq", F.coalesce(F.get(selected, F.lit(0)), F.lit("A"))).otherwise(F.array_join(selected, ""))


def needs_fallback(kind: Column | str, selected: Column | str) -> Column:
    """Single choice without exactly one true option, multiple choice without any."""
    kind, n = col(kind), F.size(col(selected))
    return ((kind == "mcq") & (n != 1)) | ((kind == "multi") & (n == 0))


def final_score(accuracy: Column | str, tokens: Column | str, budget: int) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(budget)) - col(tokens)) / F.lit(float(budget))))
    return F.lit(100.0) * col(accuracy) * (F.lit(0.7) + F.lit(0.3) * share)


def format_hits(hits: Column | str, most: int = 6) -> Column:
    """Numbered evidence blocks of an ordered array of hits (doc_id, title_path, text)."""
    block = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["doc_id"], F.lit(" | "), F.array_join(h["title_path"], " > "), F.lit("\n"), h["text"])
    return F.array_join(F.transform(F.slice(col(hits), 1, most), block), "\n\n")
