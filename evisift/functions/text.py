"""Text expressions: normalisation, tokens, titles, numbers, HTML. All are native columns but for rare entities of HTML."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.storage import unused

#: What Python's str.strip takes off, and where str.splitlines splits.
_WIDE = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACES = r"[\s\x1c-\x1f\x85" + _WIDE + "]"
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85])) + _WIDE
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def split_lines(c: Column | str) -> Column:
    """Lines; a break at the very end opens no further line."""
    return F.split(F.regexp_replace(col(c), rf"(?:{BREAKS})\z", ""), BREAKS)


def normalize_whitespace(c: Column | str) -> Column:
    """Ideographic spaces to spaces, no byte order marks, runs of blanks to one, three or more line feeds to two, stripped."""
    return strip(F.regexp_replace(single_blanks(c), r"\n{3,}", "\n\n"))


def single_blanks(c: Column | str) -> Column:
    """Ideographic spaces to spaces, no byte order marks, runs of blanks to one; only runs that change are replaced."""
    c = F.replace(F.replace(col(c), F.lit(chr(0x3000)), F.lit(" ")), F.lit(chr(0xFEFF)), F.lit(""))
    return F.regexp_replace(c, r" [ \t]++|\t[ \t]*+", " ")


def clean_lines(c: Column | str) -> Column:
    """Normalised lines that are not empty. Blanks are looked at before lines are split: no run of them holds a break."""
    return stripped_lines(single_blanks(c))


def stripped_lines(c: Column | str) -> Column:
    """Stripped lines that are not empty, otherwise as they are."""
    return F.filter(F.transform(F.split(col(c), f"{BREAK}+"), strip), lambda x: F.length(x) > 0)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), c being evaluated once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def tokenize(c: Column | str) -> Column:
    """The token bag: ASCII words with their dots and percent signs, every ideograph, every pair of neighbouring ideographs, and numbered chapters, sections and articles."""
    # Of the normalisation only the missing byte order marks matter: no token holds white space.
    return bound(F.lower(F.replace(col(c), F.lit(chr(0xFEFF)), F.lit(""))), _tokens)


def _tokens(text: Column) -> Column:
    # a pair begins at each ideograph that another follows: looked for without taking it
    runs = F.transform(F.regexp_extract_all(text, F.lit(K.CJK_RUN), F.lit(0)), lambda run: F.concat(F.regexp_extract_all(run, F.lit("."), F.lit(0)), F.regexp_extract_all(run, F.lit("(?=(..))"), F.lit(1))))
    ideographs = F.concat(F.flatten(runs), F.regexp_extract_all(text, F.lit(K.NUMBERED), F.lit(0)))
    ascii_tokens = F.regexp_extract_all(text, F.lit(K.ASCII_TOKEN), F.lit(0))
    return F.when(text.rlike(K.CJK_RUN), F.concat(ascii_tokens, ideographs)).otherwise(ascii_tokens)


def searchable_text(title_path: Column | str, text: Column | str) -> Column:
    return strip(F.concat(F.array_join(col(title_path), " "), F.lit("\n"), col(text)))


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col(c).contains(w)
    return out


def first_keyword(c: Column | str, words: Sequence[str]) -> Column:
    """The first word of the list, in the list's order, that c contains; null if none."""
    return F.coalesce(*[F.when(col(c).contains(w), F.lit(w)) for w in words])


def looks_like_heading(c: Column | str) -> Column:
    return is_heading(strip(c))


def is_heading(line: Column | str) -> Column:
    """Whether a line that is stripped already is a heading."""
    return col(line).rlike("|".join(f"(?:{p})" for p in K.HEADINGS))


def may_have_headings(c: Column | str) -> Column:
    """False only if no line of a text can be a heading or a page mark: none begins, after white space, as they do."""
    return col(c).contains("[PAGE ") | col(c).rlike(rf"(?:\A|{BREAKS})(?:{SPACES}|{chr(0xFEFF)})*(?:\p{{Nd}}|[第一二三四五六七八九十])")


def detect_title(c: Column | str, fallback: Column | str) -> Column:
    """A name in title marks within the first ten lines, else the first of them with a keyword, else the first, cut at 120."""
    return bound(F.slice(stripped_lines(c), 1, 10), lambda head: _title(head, col(fallback)))


def _title(head: Column, fallback: Column) -> Column:
    quoted = F.regexp_extract(F.array_join(head, "\n"), "《([^》]{2,100})》", 1)
    keyed = F.filter(head, lambda x: contains_any(x, K.TITLE_KEYWORDS))
    found = F.when(quoted != "", quoted).when(F.size(keyed) > 0, F.substring(F.get(keyed, F.lit(0)), 1, 120)).otherwise(F.substring(F.get(head, F.lit(0)), 1, 120))
    return F.when(F.size(head) == 0, fallback).otherwise(found)


def detect_regulatory_title(c: Column | str, fallback: Column | str) -> Column:
    """As detect_title with the limits for regulations: five lines, 80 characters; lines stay as they are."""
    lines = F.filter(F.split(col(c), f"{BREAK}+"), lambda x: F.length(strip(x)) > 0)
    return bound(F.slice(lines, 1, 10), lambda head: _regulatory_title(head, col(fallback)))


def _regulatory_title(lines: Column, fallback: Column) -> Column:
    quoted = F.regexp_extract(F.array_join(lines, "\n"), "《([^》]{2,80})》", 1)
    keyed = F.transform(F.filter(F.slice(lines, 1, 5), lambda x: contains_any(x, K.REGULATORY_TITLE_KEYWORDS)), lambda x: F.regexp_replace(x, "^[《》 ]+|[《》 ]+$", ""))
    keyed = F.filter(keyed, lambda x: F.length(x) <= 80)
    found = F.when(quoted != "", quoted).when(F.size(keyed) > 0, F.get(keyed, F.lit(0))).otherwise(F.substring(F.get(lines, F.lit(0)), 1, 80))
    return F.when(F.size(lines) == 0, fallback).otherwise(found)


def page_refs(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[PAGE (\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def number_strings(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(K.NUMBER), F.lit(0))


def as_numbers(strings: Column) -> Column:
    return F.filter(F.transform(strings, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())


def isolated_numbers(c: Column | str) -> Column:
    return as_numbers(F.regexp_extract_all(col(c), F.lit(K.ISOLATED_NUMBER), F.lit(1)))


def best_number(c: Column | str, metric_key: Column | str | None = None) -> Column:
    """For a percentage metric the last number up to 100, else the last; for any other the largest; null without numbers."""
    numbers = as_numbers(number_strings(c))
    largest = F.array_max(numbers)
    if metric_key is None:
        return largest
    percents = F.filter(numbers, lambda x: x <= 100)
    last = F.coalesce(F.try_element_at(percents, F.lit(-1)), F.try_element_at(numbers, F.lit(-1)))
    return F.when(col(metric_key) == K.PERCENT_METRIC, last).otherwise(largest)


def metric_key(c: Column | str) -> Column:
    """The first metric, in the table's order, one of whose aliases c contains."""
    return F.coalesce(*[F.when(contains_any(c, aliases), F.lit(key)) for key, aliases in K.METRIC_ALIASES])


def unit_quality(c: Column | str) -> Column:
    """How well a metric row can be read: mentions of growth, of units, of a share, and being a single line."""
    c = col(c)
    out = F.when(~c.contains("\n"), 1).otherwise(0)
    for word, points in K.ROW_POINTS:
        out = out + F.when(c.contains(word), points).otherwise(0)
    return out


def year_of(doc_id: Column | str) -> Column:
    return F.regexp_extract(col(doc_id), r"(20\p{Nd}{2})", 1)


def path_stem(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/]+?)(\.[^./]*)?$", 1)


def path_suffix(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"\.([^./]+)$", 1))


def timestamp_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))


def run_domain(run_id: Column | str) -> Column:
    """All but the last three parts of a run's name."""
    parts = F.split(col(run_id), "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 3, F.lit(0))), "_")


def run_split(run_id: Column | str) -> Column:
    return F.upper(F.try_element_at(F.split(col(run_id), "_"), F.lit(-3)))


def greedy_chunks(c: Column | str, limit: Column | int, breaks: str = "[。；！？\n]") -> Column:
    """Sentences appended until the next one would pass the limit; one that is longer by itself stays whole. A text within the limit is one chunk."""
    c, limit = col(c), F.lit(limit) if isinstance(limit, int) else limit
    parts = F.split(c, f"(?<={breaks})")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def add(a: Column, part: Column) -> Column:
        full = (F.length(a["held"]) + F.length(part) > limit) & (F.length(a["held"]) > 0)
        return F.struct(F.when(full, F.concat(a["done"], F.array(strip(a["held"])))).otherwise(a["done"]).alias("done"), F.when(full, part).otherwise(F.concat(a["held"], part)).alias("held"))

    def close(a: Column) -> Column:
        return F.when(F.length(strip(a["held"])) > 0, F.concat(a["done"], F.array(strip(a["held"])))).otherwise(a["done"])

    # bound by a lambda, so that it is evaluated once
    chunks = F.transform(F.array(F.aggregate(parts, start, add, close)), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(c)))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.get(chunks, F.lit(0)))


def once(c: Column) -> Column:
    """To be selected: c as a column that is evaluated once, however often it is used."""
    return F.explode(F.array(c))


#: Entities that are decoded by columns; pages with any other go through the standard library. The ampersand comes last.
ENTITIES = (("nbsp", chr(0xA0)), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&"))


# Markup in the order in which it begins. Values in quotes may hold what ends a tag elsewhere; scripts and styles end with their own tag alone, or with the page.
_ATTRIBUTES = r"""(?:\s++|/|=|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?)*+"""
_RAW = "|".join(rf"<{name}(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</{name}(?=[\s/>]){_ATTRIBUTES}>|\z)" for name in ("script", "style"))
_TAG = rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
_NOTE = r"<!--.*?--!?>|<!(?!--)[^>]*+>|<\?[^>]*+>"
_UNSEEN = rf"<noscript(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</noscript(?=[\s/>]){_ATTRIBUTES}>|\z)"
#: Stands where a note was, so that what was around it doesn't become markup; no character of text.
_MARK = chr(0xFDD0)
#: Markup whose meaning depends on more than that: marked sections, odd ends, short comments, elements of raw text, scripts within noscript, elements that end at once, tags that never end or are very long.
_ODD = r"(?is)<!\[|</[^a-z]|<!--?-?>|<(?:plaintext|textarea|title|xmp|iframe|noembed|noframes)[\s/>]|<noscript[\s/>].*?<(?:/?(?:script|style)|noscript)[\s/>]|<(?:script|style|noscript)[^>]*/>|<[a-z/!?][^>]*+\z|<[a-z/!?][^>]{2000}"


def html_nodes(c: Column | str) -> Column:
    """A page without comments, declarations, scripts and styles, a line for every text node that a tag ends, entities as they are. The page is taken apart from its beginning, a piece of markup after the other: first notes go, while tags and scripts are passed over, then these."""
    c = F.regexp_replace(col(c), rf"(?is)(?:{_NOTE})|({_RAW}|{_TAG})", "$1" + _MARK)
    return F.translate(F.regexp_replace(c, rf"(?is){_RAW}|{_UNSEEN}|{_TAG}", "\n"), _MARK, "")


def odd_html(c: Column | str, nodes: Column | str) -> Column:
    """Whether a page has markup that html_nodes may not take apart as a parser does."""
    return col(c).rlike(_ODD) | col(nodes).contains("<!--")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "noscript")
        self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0
        self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def parsed_html(pages: Column) -> Column:
    """Text nodes of pages, entities decoded, by the standard library's parser in Arrow batches."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        return "".join(p.out)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    return run(pages)


def other_entities(nodes: Column | str) -> Column:
    """Whether an ampersand is there that begins none of ENTITIES and may begin another entity."""
    known = "|".join(name for name, _ in ENTITIES)
    return col(nodes).rlike(f"&(?!(?:{known});)[#a-zA-Z]")


def known_entities(nodes: Column | str) -> Column:
    c = col(nodes)
    for name, text in ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(text))
    return c


def unescaped(nodes: Column | str) -> Column:
    """nodes with all entities decoded by the standard library, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else html.unescape(x))

    return run(col(nodes))


#: An ampersand that begins no reference ended by a semicolon.
_BARE = "&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)"


def with_html_text(df: DataFrame, page: Column | str, name: str, ended: bool = False) -> DataFrame:
    """df with the text of pages: cleaned lines, joined. All numeric and named entities are decoded. Pages with odd markup go through the parser, those with entities other than ENTITIES through the library's decoder. ended: whether only references are decoded that a semicolon ends; a browser also reads some without it."""
    nodes, plain = unused(df.columns, "nodes", "plain")
    if ended:
        page = F.regexp_replace(col(page), _BARE, "&amp;")
    rows = df.select("*", once(html_nodes(page)).alias(nodes))
    odd = odd_html(page, nodes)
    needs = other_entities(nodes) & ~odd
    rows = rows.withColumn(plain, F.coalesce(parsed_html(F.when(odd, col(page))), unescaped(F.when(needs, F.col(nodes))), known_entities(nodes)))
    return rows.withColumn(name, F.array_join(clean_lines(plain), "\n")).drop(nodes, plain)


def html_title(c: Column | str) -> Column:
    """Content of the meta tag named ArticleTitle."""
    a = F.regexp_extract(col(c), r"(?is)<meta\b[^>]*\bname\s*=\s*[\"']ArticleTitle[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(col(c), r"(?is)<meta\b[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*\bname\s*=\s*[\"']ArticleTitle[\"']", 1)
    return strip(F.when(a != "", a).otherwise(b))
