"""Sources: documents as text, HTML or PDF, manifests, questions and gold answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.functions.text import clean_lines, html_title, normalize_whitespace, parsed_html, path_stem, path_suffix, with_html_text
from evisift.storage import running

QUESTION = "qid string, domain string, split string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>"
#: (path, bytes) -> text of each page.
PdfReader = Callable[[bytes], list[str]]


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below path, content only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(domain, doc_id, source_path, source_type): a document's id is its file's stem, its type the suffix."""
    return files(spark, path).select(F.lit(domain).alias("domain"), path_stem("path").alias("doc_id"), F.col("path").alias("source_path"), path_suffix("path").alias("source_type"))


def manifest(found: DataFrame, regulatory: bool) -> DataFrame:
    """One file for each (domain, doc_id) and doc_seq, its place. Regulations take PDF before text before HTML; other domains the last path."""
    rank = F.when(F.col("source_type") == "pdf", 0).when(F.col("source_type") == "txt", 1).otherwise(2)
    order = [rank, F.desc("source_path")] if regulatory else [F.desc("source_path")]
    one = found.withColumn("r", F.row_number().over(Window.partitionBy("domain", "doc_id").orderBy(*order))).filter("r = 1").drop("r")
    placed = running(one.withColumn("one", F.lit(1)), ["domain", "doc_id"], {"place": "one"})
    first = placed.groupBy("domain").agg(F.min("place").alias("first"))  # a row a domain
    return placed.join(F.broadcast(first), "domain").select(*found.columns, (F.col("place") - F.col("first") + 1).cast("int").alias("doc_seq"))


def referenced(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """docs that questions refer to; all of them if no question names any."""
    return docs.join(refs.select("doc_id").distinct(), "doc_id", "left_semi") if refs.limit(1).count() else docs


def referenced_ids(questions: DataFrame) -> DataFrame:
    return questions.select(F.explode("doc_ids").alias("doc_id")).distinct().orderBy("doc_id")


def decoded(content: str = "content") -> Column:
    """Text of UTF-8 bytes; bytes that are none are left out."""
    return F.regexp_replace(F.col(content).cast("string"), chr(0xFFFD), "")


def text_documents(files_: DataFrame) -> DataFrame:
    return files_.select("*", normalize_whitespace(decoded()).alias("text"), F.lit("").alias("meta_title"), F.lit(None).cast("int").alias("page_count"))


def html_documents(files_: DataFrame, exact: bool = False) -> DataFrame:
    """Text and meta title of HTML. exact parses all pages in Arrow batches, not the odd ones alone."""
    html = decoded()
    rows = files_.withColumn("text", F.array_join(clean_lines(parsed_html(html)), "\n")) if exact else with_html_text(files_, html, "text")
    return rows.select(*files_.columns, "text", html_title(html).alias("meta_title"), F.lit(None).cast("int").alias("page_count"))


def pdf_pages(content: bytes) -> list[str]:
    try:
        from io import BytesIO

        from pypdf import PdfReader as Reader
    except ImportError as e:
        raise RuntimeError("PDF sources need pypdf, or a reader of your own passed as pdf=") from e
    return [page.extract_text() or "" for page in Reader(BytesIO(content)).pages]


def pdf_documents(files_: DataFrame, pdf: PdfReader = pdf_pages) -> DataFrame:
    """Pages that have text, each after its mark, two line feeds apart."""
    keep = [c for c in files_.columns if c != "content"]
    kinds = dict(files_.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[keep].assign(pages=[pdf(bytes(c)) for c in p["content"]])

    pages = files_.select(*keep, "content").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", pages array<string>")
    clean = F.transform(F.col("pages"), lambda x, i: F.struct((i + 1).alias("i"), normalize_whitespace(x).alias("t")))
    marked = F.transform(F.filter(clean, lambda x: F.length(x["t"]) > 0), lambda x: F.concat(F.lit("[PAGE "), x["i"].cast("string"), F.lit("]\n"), x["t"]))
    return pages.select(*keep, F.array_join(marked, "\n\n").alias("text"), F.lit("").alias("meta_title"), F.size("pages").alias("page_count"))


def load_documents(spark: SparkSession, manifest_: DataFrame, path: str, pdf: PdfReader = pdf_pages) -> DataFrame:
    """manifest_ with text, meta_title and page_count, by the documents' types; an unknown type is an error."""
    rows = manifest_.join(files(spark, path).select(F.col("path").alias("source_path"), "content"), "source_path")
    known = rows.filter(F.when(F.col("source_type").isin("txt", "html", "pdf"), True).otherwise(F.raise_error(F.concat(F.lit("unsupported source type: "), "source_type"))))
    parts = [text_documents(known.filter("source_type = 'txt'")).drop("content"), html_documents(known.filter("source_type = 'html'")).drop("content"), pdf_documents(known.filter("source_type = 'pdf'"), pdf)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files: an object or an array of objects each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_questions(spark: SparkSession, path: str, split: str | None = None, qid: str | None = None, limit: int | None = None) -> DataFrame:
    """Questions with ord, their place; a missing doc_ids is an empty list. The limit comes after the filters."""
    q = read_json(spark, path, QUESTION).withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>"))).withColumn("file_place", F.monotonically_increasing_id())
    if split is not None:
        q = q.filter(F.col("split") == split)
    if qid is not None:
        q = q.filter(F.col("qid") == qid)
    q = running(q.withColumn("one", F.lit(1)), ["file_place"], {"place": "one"}).withColumn("ord", (F.col("place") + 1).cast("int")).drop("file_place", "one", "place")
    return q.orderBy("ord").limit(limit) if limit is not None else q


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, "qid string, answer string")
