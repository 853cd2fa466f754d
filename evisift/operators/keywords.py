"""Keywords as a table of any size: which texts contain which.

Keywords of up to BLOCKS times BLOCK bytes, none long, are collected, and automata of a block of
them each scan the texts: one pass a block, in which each row is dealt with in its task.

For others, an index of q-grams and an exact check. A keyword can only be in a text that
has all its grams, so one of them, the rarest in the texts, is its anchor. Texts' grams that are an anchor are joined to the
keywords that have it, and the pairs are checked by looking for the keyword itself.
Keywords of less than GRAM characters are their own anchor, among grams of their size.

Nulls and empty texts contain nothing; null and empty keywords are in nothing. Equal
keywords are looked for once and found in each of their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.operators import automaton
from evisift.operators.bm25 import small
from evisift.storage import materialize, spread, unused

GRAM = 4
#: Bytes of keywords in an automaton, each counting as WORD more; how many times that are collected. An automaton takes a kilobyte a byte at most.
BLOCK, WORD, BLOCKS = 1 << 18, 4, 16
#: Automata are for keywords of at most so many bytes.
LONGEST = 256


def grams(text: Column, size: int) -> Column:
    """The distinct grams of a text: at each place the characters ahead, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def texts_grams(texts: DataFrame, key: str, text: str, sizes: Sequence[int]) -> DataFrame:
    """(key, gram): the distinct grams of each text, of all sizes."""
    return texts.filter(F.length(text) > 0).select(key, F.explode(F.concat(*[grams(F.col(text), n) for n in sizes])).alias("gram"))


def scannable(words: DataFrame) -> bool:
    """Whether the column ``word`` is within the blocks' bounds."""
    size = F.octet_length("word").cast("bigint")
    total, most = words.agg(F.sum(size + WORD), F.max(size)).first()
    return (total or 0) <= BLOCK * BLOCKS and (most or 0) <= LONGEST


def blocks(words: DataFrame) -> Iterator[tuple[tuple, ...]]:
    """The columns of words, the first being the word, in order, a block at a time."""
    held, size = [], 0
    for r in words.collect():
        if held and size + len(r[0]) + WORD > BLOCK:
            yield tuple(zip(*held, strict=True))
            held, size = [], 0
        held.append((bytes(r[0]), *r[1:]))
        size += len(r[0]) + WORD
    if held:
        yield tuple(zip(*held, strict=True))


def bodies(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body), bytes; texts that contain nothing are left out."""
    return spread(texts.select(key, text)).filter(F.length(text) > 0).select(key, F.col(text).cast("binary").alias("body"))


def contained(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword") -> DataFrame:
    """keywords' columns and ``key``, for each text and keyword that is in it. Texts that share a key are looked at together."""
    words = materialize(keywords.select(F.col(keyword).alias("word")).filter(F.length("word") > 0).distinct(), "words")
    if words.isEmpty():
        return keywords.limit(0).crossJoin(texts.select(key).limit(0))
    found = scanned(texts, words, key, text) if scannable(words) else joined(texts, words, key, text)
    (own_key,) = unused(keywords.columns, key)
    return keywords.join(found.withColumnRenamed(key, own_key), F.col(keyword) == F.col("word")).drop("word")


def scanned(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word), by automata."""
    rows = bodies(texts, key, text).filter(F.col(key).isNotNull())
    schema = rows.select(key, F.array("body").alias("words")).schema

    def of(block: tuple[tuple, ...]) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast(block[0])
        return rows.mapInArrow(automaton.listing(uuid.uuid4().hex, lambda: held.value, key), schema)

    found = reduce(DataFrame.unionByName, map(of, blocks(words.select(F.col("word").cast("binary")))))
    return found.select(key, F.explode("words").alias("word")).select(key, F.col("word").cast("string").alias("word")).distinct()


def joined(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word), by grams."""
    sizes = [r[0] for r in words.select(F.least(F.length("word"), F.lit(GRAM)).alias("n")).distinct().orderBy("n").collect()]
    rows = spread(texts.select(key, text))
    own = words.select("word", F.explode(F.when(F.length("word") >= GRAM, grams(F.col("word"), GRAM)).otherwise(F.array("word"))).alias("gram"))
    own = materialize(own, "grams")
    every = texts_grams(rows, key, text, sizes)
    met = every.join(small(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("word").orderBy("n", "gram")
    # a keyword one of whose grams no text has is in none: it has no anchor
    counted = own.join(small(materialize(met, "met")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = materialize(counted.withColumn("r", F.row_number().over(rarest)).filter("r = 1 AND n > 0").select("gram", "word"), "anchors")
    # a row a text, so that no text is repeated for each of its words
    pairs = materialize(every.join(small(anchors), "gram").groupBy(key).agg(F.collect_set("word").alias("words")), "pairs")
    return pairs.join(rows, key).select(key, F.explode(F.filter("words", lambda w: F.contains(F.col(text), w))).alias("word")).distinct()


def tally(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword", place: str = "place") -> DataFrame:
    """(key, n, first): over the texts of a key, how many keywords each contains, summed, and of all of these the one with the lowest place; keys without any are left out. keywords has each keyword once, places are different. No pair of a text and a keyword is made a row."""
    words = keywords.select(F.col(keyword).alias("word"), F.col(place).cast("bigint").alias("place")).filter(F.length("word") > 0)
    if scannable(words):
        rows = bodies(texts, key, text)
        schema = rows.select(key, F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("place"), F.col("body").alias("word")).schema

        def of(block: tuple[tuple, ...]) -> DataFrame:
            held = texts.sparkSession.sparkContext.broadcast(block)
            return rows.mapInArrow(automaton.counting(uuid.uuid4().hex, lambda: held.value, key), schema)

        each = [of(b) for b in blocks(words.select(F.col("word").cast("binary"), "place").orderBy("place"))]
        found = reduce(DataFrame.unionByName, each) if each else texts.sparkSession.createDataFrame([], schema)
    else:
        (row,) = unused([key, text, "word", "place"], "row")
        rows = materialize(texts.select(key, text, F.monotonically_increasing_id().alias(row)), "numbered")
        pairs = contained(rows, words.withColumnRenamed("word", "keyword"), row, text)
        found = pairs.join(rows.select(key, row), row).select(key, F.lit(1).alias("n"), "place", F.col("keyword").alias("word"))
    return found.groupBy(key).agg(F.sum("n").alias("n"), F.min_by("word", "place").cast("string").alias("first"))


def first_contained(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword", place: str = "place", value: str = "value") -> DataFrame:
    """(key, value): of the keywords in a text the value of the one with the lowest place; texts without any are left out."""
    return contained(texts, keywords, key, text, keyword).groupBy(key).agg(F.min_by(value, place).alias(value))
