"""Sections, articles, line windows and chunks: documents to evidence units.

Documents are (doc_id, title, text); lines carry their number, and units a class,
section and chunk number that make their order within the document explicit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.functions.text import clean_lines, first_keyword, greedy_chunks, is_heading, may_have_headings, number_strings, once, page_refs, strip, stripped_lines, year_of
from evisift.operators.bm25 import small
from evisift.storage import materialize, running, spread, unused

METADATA = "struct<article_no:string,chunk_index:int,metric_name:string,year:string,element_name:string,numbers:array<string>>"


def metadata(**fields: Column) -> Column:
    kinds = {"chunk_index": "int", "numbers": "array<string>"}
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in ("article_no", "chunk_index", "metric_name", "year", "element_name", "numbers")])


def numbered_lines(docs: DataFrame, lines: Column) -> DataFrame:
    """(doc_id, title, n, line) of a document's lines, n from 0."""
    return spread(docs).select("doc_id", "title", once(lines).alias("lines")).select("doc_id", "title", F.posexplode("lines").alias("n", "line"))


#: Documents of more characters are taken in segments of so many lines, and their lines' state is carried over these.
LONG_TEXT, SEGMENT = 1 << 20, 1 << 13


def by_length(docs: DataFrame, make: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """make(docs, None) of the documents that a task takes whole, and make(docs, SEGMENT) of the long ones, if there are any: docs are looked through for them."""
    long = F.coalesce(F.length("text") > LONG_TEXT, F.lit(False))
    if docs.filter(long).isEmpty():
        return make(docs, None)
    return make(docs.filter(~long), None).unionByName(make(docs.filter(long), SEGMENT))


def state(rows: DataFrame, segment: int | None, n: str = "n", last: dict[str, Column] | None = None, before: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with, by name, what the rows of the document come to up to each in the order of ``n``: the last value that isn't null, the same without the row itself (before), the sum.

    segment: None for one task a document; else its rows are taken by so many at once. Each segment is reduced to its effect, its last values and its sums; effects are composed in order, a row a segment, and what comes in is applied to the rows of the next ones."""
    last, before, sums = last or {}, before or {}, sums or {}
    taken = {**last, **before}
    by = ["doc_id"]
    if segment is not None:
        part, *held = unused(rows.columns, "part", *[f"{name}_value" for name in (*taken, *sums)])
        rows = rows.withColumn(part, F.floor(F.col(n) / segment))
        for h, value in zip(held, (*taken.values(), *sums.values()), strict=True):
            rows = rows.withColumn(h, value)
        rows = materialize(rows, "lines")
        last, before, sums = ({name: F.col(held[[*taken, *sums].index(name)]) for name in d} for d in (last, before, sums))
        by.append(part)
    order = Window.partitionBy(*by).orderBy(n)
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.last(v, ignorenulls=True).over(upto).alias(k) for k, v in last.items()], *[F.last(v, ignorenulls=True).over(earlier).alias(k) for k, v in before.items()], *[F.sum(v).over(upto).alias(k) for k, v in sums.items()])
    if segment is None:
        return out
    came = unused([*out.columns], *[f"{k}_in" for k in (*last, *before, *sums)])
    effects = rows.groupBy(*by).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col(n))).alias(c) for c, v in zip(came, (*last.values(), *before.values()), strict=False)], *[F.sum(v).alias(c) for c, v in zip(came[len(taken) :], sums.values(), strict=True)])
    earlier = Window.partitionBy("doc_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    composed = effects.select(*by, *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in came[: len(taken)]], *[F.sum(c).over(earlier).alias(c) for c in came[len(taken) :]])
    out = out.join(small(materialize(composed, "effects")), by, "left")
    for k, c in zip((*last, *before), came, strict=False):
        out = out.withColumn(k, F.coalesce(k, c))
    for k, c in zip(sums, came[len(taken) :], strict=True):
        out = out.withColumn(k, F.col(k) + F.coalesce(c, F.lit(0)))
    return out.drop(part, *held, *came)


def split_sections(docs: DataFrame, prefix: str = "sec", unit_type: str = "paragraph", max_chars: int = 1200, headed: bool = True) -> DataFrame:
    """Sections: a heading line closes what has been collected, names what follows and is no text itself. Page marks count to the section that collects text after the last closing. Sections without text vanish and take no number. A document in which no line can be a heading or a page mark is one section, without a look at its lines' order. headed: False for texts that are known to have neither, where a line that looks like one is text as any other."""
    marked = F.coalesce(may_have_headings("text"), F.lit(False)) if headed else F.lit(False)
    whole = spread(docs).filter(~marked).select("doc_id", "title", once(F.array_join(clean_lines("text"), "\n")).alias("text"))
    whole = whole.filter(F.length("text") > 0).select("doc_id", "title", F.lit(1).alias("section_seq"), "text", F.lit(None).cast("string").alias("head"), F.array().cast("array<int>").alias("page_refs"))
    out = whole.unionByName(headed_sections(docs.filter(marked))) if headed else whole
    path = F.when(F.col("head").isNull() | (F.col("head") == F.col("title")), F.array("title")).otherwise(F.array("title", "head"))
    return out.select("doc_id", "section_seq", F.concat(F.lit(f"{prefix}_"), F.col("section_seq")).alias("section_id"), path.alias("title_path"), "text", F.lit(unit_type).alias("unit_type"), "page_refs", F.lit(max_chars).alias("max_chars"), metadata().alias("metadata"))


def headed_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, title, section_seq, text, head, page_refs) by headings and page marks."""
    return by_length(docs, _headed)


def _headed(docs: DataFrame, segment: int | None) -> DataFrame:
    rows = numbered_lines(docs, clean_lines("text"))
    kind = F.when(F.col("line").startswith("[PAGE "), "page").when(is_heading("line"), "heading").otherwise("text")
    rows = rows.withColumn("kind", kind)
    # what stood before, page marks aside
    rows = state(rows, segment, before={"prior": F.when(F.col("kind") != "page", F.col("kind"))}, last={"head": F.when(F.col("kind") == "heading", F.substring("line", 1, 120))})
    opens = ((F.col("kind") == "heading") & (F.col("prior") == "text")).cast("int")
    rows = state(rows, segment, sums={"g": F.coalesce(opens, F.lit(0))})
    text = F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("n", "line"))))["line"]
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "page", page_refs("line"))))))
    out = rows.groupBy("doc_id", "title", "g").agg(strip(F.array_join(text, "\n")).alias("text"), F.min_by("head", F.when(F.col("kind") == "text", F.col("n"))).alias("head"), pages.alias("page_refs"))
    out = state(out.filter(F.length("text") > 0), segment, "g", sums={"section_seq": F.lit(1)}).withColumn("section_seq", F.col("section_seq").cast("int"))
    return out.select("doc_id", "title", "section_seq", "text", "head", "page_refs")


def line_windows(docs: DataFrame, keywords: Sequence[str], before: int, after: int, lines: Column | None = None) -> DataFrame:
    """(doc_id, title, n, line, keyword, window): for each line with a keyword, the first of the list that it has, and the lines around it."""

    def make(docs: DataFrame, segment: int | None) -> DataFrame:
        rows, by = numbered_lines(docs, stripped_lines("text") if lines is None else lines), ["doc_id"]
        if segment is not None:  # a line goes to all segments in which it is in a window
            parts = F.sequence(F.floor(F.greatest(F.col("n") - after, F.lit(0)) / segment), F.floor((F.col("n") + before) / segment))
            rows, by = rows.withColumn("part", F.explode(parts)), ["doc_id", "part"]
        around = Window.partitionBy(*by).orderBy("n").rowsBetween(-before, after)
        rows = rows.withColumn("window", F.array_join(F.collect_list("line").over(around), "\n"))
        if segment is not None:
            rows = rows.filter(F.col("part") == F.floor(F.col("n") / segment)).drop("part")
        return rows.withColumn("keyword", first_keyword("line", keywords)).filter(F.col("keyword").isNotNull())

    return by_length(docs, make)


def metric_sections(docs: DataFrame, max_chars: int = 600) -> DataFrame:
    """A section for each line that names a metric and has a digit, with the lines before and after it; notes count only if they compare years."""
    rows = line_windows(docs, K.FINANCIAL_METRICS, 1, 1)
    note = F.substring("line", 1, 3).contains("注") & ~F.col("line").contains("同比")
    rows = rows.filter(F.col("line").rlike(r"\p{Nd}") & ~note)
    rows = rows.withColumn("section_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    meta = metadata(metric_name=F.col("keyword"), year=year_of("doc_id"), numbers=number_strings("window"))
    return _special(rows, "metric_", "metric_row", max_chars, meta)


def element_sections(docs: DataFrame, max_chars: int = 700) -> DataFrame:
    """A section for each line that names a contract element, with one line before and two after; its number is the line's."""
    rows = line_windows(docs, K.CONTRACT_KEYWORDS, 1, 2).withColumn("section_seq", (F.col("n") + 1).cast("int"))
    return _special(rows, "element_", "element_block", max_chars, metadata(element_name=F.col("keyword"), numbers=number_strings("window")))


def _special(rows: DataFrame, prefix: str, unit_type: str, max_chars: int, meta: Column) -> DataFrame:
    return rows.select("doc_id", "section_seq", F.concat(F.lit(prefix), F.col("section_seq")).alias("section_id"), F.array("title", "keyword").alias("title_path"), F.col("window").alias("text"), F.lit(unit_type).alias("unit_type"), F.array().cast("array<int>").alias("page_refs"), F.lit(max_chars).alias("max_chars"), meta.alias("metadata"))


def section_units(sections: DataFrame, class_seq: int = 0) -> DataFrame:
    """Units of sections, in chunks of max_chars; ids tell chunks apart only if there are several."""
    rows = sections.withColumn("text", strip("text")).filter(F.length("text") > 0)
    rows = rows.select("*", once(greedy_chunks("text", F.col("max_chars"))).alias("chunks")).drop("text").withColumn("n_chunks", F.size("chunks"))
    rows = rows.select(*[c for c in rows.columns if c != "chunks"], F.posexplode("chunks").alias("chunk_seq", "chunk"))
    base = F.concat_ws("::", "doc_id", "section_id")
    unit_id = F.when(F.col("n_chunks") > 1, F.concat(base, F.lit("::chunk_"), F.col("chunk_seq") + 1)).otherwise(base)
    return rows.select(unit_id.alias("unit_id"), "doc_id", "unit_type", "title_path", F.col("chunk").alias("text"), "page_refs", F.lit(None).cast("string").alias("parent_unit_id"), "metadata", F.lit(class_seq).alias("class_seq"), "section_seq", "chunk_seq")


def regulatory_units(docs: DataFrame, max_chars: int = 1200) -> DataFrame:
    """Units of regulations: what stands before the first article, and articles.

    An article without a line below its heading line gives no unit. Chapter and
    section are those known when the next article begins (or the text ends), so
    the last article before a new chapter is filed under the new one; a section
    stays in force over chapters.
    """
    return by_length(docs, lambda some, segment: _articles(some, segment, max_chars))


def _articles(docs: DataFrame, segment: int | None, max_chars: int) -> DataFrame:
    rows = numbered_lines(docs, clean_lines("text"))
    kind = F.when(F.col("line").rlike(K.CHAPTER), "chapter").when(F.col("line").rlike(K.SECTION), "section").when(F.col("line").rlike(K.ARTICLE), "article").otherwise("text")
    rows = rows.withColumn("kind", kind)

    def named(k: str, pattern: str) -> Column:
        name = F.concat_ws(" ", F.regexp_extract("line", pattern, 1), F.when(F.regexp_extract("line", pattern, 2) != "", F.regexp_extract("line", pattern, 2)))
        return F.when(F.col("kind") == k, strip(name))

    last = {"chapter": named("chapter", K.CHAPTER), "section": named("section", K.SECTION)}
    rows = state(rows, segment, last=last, sums={"a": (F.col("kind") == "article").cast("int")})
    body = F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("n", "line"))))["line"]
    found = rows.groupBy("doc_id", "title", "a").agg(
        strip(F.array_join(body, "\n")).alias("body"),
        F.min(F.when(F.col("kind") == "article", F.regexp_extract("line", K.ARTICLE, 1))).alias("no"),
        F.min(F.when(F.col("kind") == "article", strip(F.regexp_extract("line", K.ARTICLE, 2)))).alias("heading"),
        F.max_by(F.struct("chapter", "section"), "n").alias("at_end"),  # context in force when the article is closed
    )
    found = found.filter(F.length("body") > 0)  # what is used again below is bound, so that it isn't made again for each use
    path = F.filter(F.array("title", "at_end.chapter", "at_end.section", "no"), lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))
    full = strip(F.concat(strip(F.concat_ws(" ", "no", "heading")), F.lit("\n"), F.col("body")))
    found = found.select("*", once(F.when(F.col("a") == 0, F.col("body")).otherwise(full)).alias("full")).drop("body")
    long = (F.col("a") > 0) & (F.length("full") > max_chars)
    found = found.select("*", long.alias("long"), F.posexplode(F.when(long, greedy_chunks("full", max_chars, "。")).otherwise(F.array("full"))).alias("chunk_seq", "chunk")).drop("full")
    base = F.concat_ws("::", "doc_id", F.when(F.col("a") == 0, F.lit("preamble")).otherwise(F.col("no")))
    return found.select(
        F.when(F.col("long"), F.concat(base, F.lit("::chunk_"), F.col("chunk_seq") + 1)).otherwise(base).alias("unit_id"),
        "doc_id",
        F.when(F.col("a") == 0, "preamble").when(F.col("long"), "article_chunk").otherwise("article").alias("unit_type"),
        F.when(F.col("a") == 0, F.array("title", F.lit("preamble"))).otherwise(path).alias("title_path"),
        F.col("chunk").alias("text"),
        F.array().cast("array<int>").alias("page_refs"),
        F.when(F.col("long"), base).alias("parent_unit_id"),
        F.when(F.col("a") == 0, metadata()).otherwise(metadata(article_no=F.col("no"), chunk_index=F.when(F.col("long"), F.col("chunk_seq") + 1))).alias("metadata"),
        F.lit(0).alias("class_seq"),
        F.col("a").cast("int").alias("section_seq"),
        "chunk_seq",
    )


def with_positions(units: DataFrame, docs: DataFrame) -> DataFrame:
    """units with ``pos``, their place among all units: documents in the order of doc_seq. Documents' counts are summed by ranges."""
    order = ["class_seq", "section_seq", "chunk_seq"]
    units = materialize(units, "units")  # counted, then numbered: parsed once
    counts = docs.select("doc_id", "doc_seq").join(units.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    starts = running(counts, ["doc_seq", "doc_id"], {"start": "n"}).select("doc_id", "start")
    within = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return units.withColumn("within", within).join(starts, "doc_id").withColumn("pos", F.col("start") + F.col("within")).drop("start", "within", *order)
