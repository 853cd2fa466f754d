"""BM25 over an inverted index.

Statistics are those of all units; a filter on documents applies to scores only.
A query is a bag: a token that it has n times counts n times. Scores are sums of
terms rounded to integers of 1e-9, so they don't depend on the order of addition.

Units are tokenised once: postings hold, beside the tokens, a row that carries each
unit's length (its token is a mark and a number, so that these rows spread).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.functions import constants as K
from evisift.functions.text import tokenize
from evisift.operators import bags as bags_of
from evisift.storage import materialize, spread

#: A table of at most so many rows may be broadcast; one of so many pairs of keys.
BROADCAST_ROWS, BROADCAST_PAIRS = 50_000, 200_000
#: Begins the token of a row that carries a unit's length; how many such tokens there are.
MARK, MARKS = chr(0), 1000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size is within bounds; its rows are counted for that. most: more for rows of a few numbers."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def measured(units: DataFrame, key: str, text: Column | str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, dl, tokens), the tokens sorted. Exploding an array of one keeps the optimiser from evaluating the tokens once for each use of theirs. The length is a column of its own before tokens are exploded: computed beside that it would carry the whole array along with every token."""
    rows = spread(units.select(key, *keep, (F.col(text) if isinstance(text, str) else text).alias("body")))
    rows = rows.select(key, *keep, F.explode(F.array(F.sort_array(tokenize("body")))).alias("tokens"))
    return rows.select(key, *keep, F.size("tokens").cast("bigint").alias("dl"), "tokens")


def counted(rows: DataFrame, others: Sequence[str | Column], n: str) -> DataFrame:
    """others, token and its count ``n`` in the row's sorted ``tokens``: lengths of the runs, so that nothing is shuffled."""
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    rows = rows.filter(F.size("tokens") > 0).select(*others, "tokens", F.explode(F.array(starts)).alias("starts"))
    runs = F.transform("starts", lambda s, k: F.struct(F.get("tokens", s).alias("token"), (F.coalesce(F.get("starts", k + 1), F.size("tokens")) - s).cast("bigint").alias(n)))
    return rows.select(*others, F.inline(runs))


def token_bag(df: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(key, token, n): how often each token occurs. Rows that share a key are added up; keys are looked through for these first, so that the tokens of the others aren't shuffled."""
    shared = materialize(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(key), "shared")
    found = counted(measured(df, key, text), [key], "n")
    null = df.filter(F.col(key).isNull()).limit(2).count() > 1
    if shared.isEmpty() and not null:
        return found
    some = small(shared)
    among = found.join(some, key, "left_semi").unionByName(found.filter(F.col(key).isNull()))
    return found.filter(F.col(key).isNotNull()).join(some, key, "left_anti").unionByName(among.groupBy(key, "token").agg(F.sum("n").alias("n")))


def term_frequencies(units: DataFrame, key: str = "pos", text: Column | str = "text") -> DataFrame:
    return token_bag(units, key, text).withColumnRenamed("n", "tf")


def unit_lengths(units: DataFrame, key: str = "pos", text: Column | str = "text") -> DataFrame:
    """(key, dl): tokens of each unit; a unit without any has 0."""
    return measured(units, key, text).select(key, "dl")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_units, avgdl; an average of 0 counts as 1."""
    avg = F.sum("dl") / F.count("*")
    return lengths.agg(F.count("*").alias("n_units"), F.when(avg > 0, avg).otherwise(F.lit(1.0)).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column | str = "df", n: Column | str = "n_units") -> Column:
    df, n = (F.col(c) if isinstance(c, str) else c for c in (df, n))
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(qtf: Column, idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K.K1, b: float = K.B) -> Column:
    """What a token adds, in units of 1e-9."""
    norm = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.greatest(dl, F.lit(1)) / avgdl)
    return F.round(qtf * (idf_ * tf * F.lit(k1 + 1) / norm) * F.lit(1e9)).cast("bigint")


def index(units: DataFrame, key: str = "pos", text: Column | str = "text", keep: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """Postings (key, *keep, dl, token, tf), with a row for each unit's length; of the tokens that are ``wanted`` only, if given. To be written and read by scores()."""
    rows = measured(units, key, text, keep)
    found = counted(rows, [key, *keep, "dl"], "tf")
    if wanted is not None:
        found = found.join(small(materialize(wanted.select("token"), "wanted")), "token", "left_semi").select(*found.columns)
    return found.unionByName(rows.select(key, *keep, "dl", marked(key).alias("token"), F.lit(1).cast("bigint").alias("tf")))


def tokenized(units: DataFrame, key: str, text: Column | str, keep: Sequence[str]) -> DataFrame:
    """(key, *keep, tokens)"""
    return spread(units.select(key, *keep, (F.col(text) if isinstance(text, str) else text).alias("body"))).select(key, *keep, tokenize("body").alias("tokens"))


def whole_bags(units: DataFrame, key: str = "pos", text: Column | str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """What index() gives, a row a unit: (key, *keep, dl, tokens, tfs), of different tokens and how often each occurs."""
    kept = [c for c in keep if c != key]
    made = T.StructType([*[units.schema[c] for c in (key, *kept)], T.StructField("dl", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return tokenized(units, key, text, kept).mapInArrow(bags_of.counting(None, [key, *kept]), made)


def marked(key: str) -> Column:
    """The token of the row that carries a unit's length."""
    return F.concat(F.lit(MARK), F.pmod(F.xxhash64(key), F.lit(MARKS)).cast("string"))


def posted(bags: DataFrame, key: str = "pos", keep: Sequence[str] = ()) -> DataFrame:
    """index()'s rows of whole_bags()' ones."""
    both = F.concat(F.array(F.struct(marked(key).alias("token"), F.lit(1).alias("tf"))), F.arrays_zip(F.col("tokens").alias("token"), F.col("tfs").alias("tf")))
    return bags.select(key, *keep, "dl", F.inline(both)).withColumn("tf", F.col("tf").cast("bigint"))


def asked_postings(units: DataFrame | None, bag: DataFrame, key: str, text: Column | str, keep: Sequence[str], postings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The postings of the tokens of ``bag``, and those of all units' lengths."""
    wanted = bag.select("token").distinct()
    if postings is None:
        postings = materialize(index(units, key, text, keep, wanted), "postings")
    mark = F.col("token").startswith(MARK)
    return postings.filter(~mark).join(small(wanted), "token", "left_semi"), postings.filter(mark)


def scores(
    units: DataFrame | None, queries: DataFrame, key: str = "pos", text: Column | str = "text", query: str = "query_id", query_text: str = "query_text", k1: float = K.K1, b: float = K.B,
    keep: Sequence[str] = (), allowed: DataFrame | None = None, postings: DataFrame | None = None,
) -> DataFrame:
    """(query, key, *keep, score) of all units that share a token with a query. allowed: (query, doc_id), written already, of the documents that a query may have; doc_id is in ``keep`` then. Units of others are never scored, but lengths and statistics are of all units. postings: an index with ``keep``; else one of the queries' tokens is made of units."""
    bag = materialize(token_bag(queries, query, query_text).withColumnRenamed("n", "qtf"), "bag")
    tf, lengths = asked_postings(units, bag, key, text, keep, postings)
    weights = document_frequencies(tf).crossJoin(F.broadcast(corpus_stats(lengths)))  # one row
    asked = materialize(bag.join(weights.select("token", idf().alias("idf"), "avgdl"), "token"), "asked")
    if allowed is None:
        hit = tf.join(small(asked), "token")
    else:
        hit = tf.join(small(asked.join(allowed, query)), ["token", "doc_id"])
    term = term_score(F.col("qtf"), F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return hit.groupBy(query, key, *keep).agg(F.sum(term).alias("s")).select(query, key, *keep, (F.col("s") / F.lit(1e9)).alias("score"))


#: Postings that the first pass takes: those of a query's so many tokens of the highest bounds with at least so much of the highest impact. Candidates of the first pass for each place.
TOP_TOKENS, TOP_BLOCK, CANDIDATES = 12, 0.5, 3
#: What the bounds of the tokens that the second pass leaves out may make of a threshold.
LEFT_OUT = 0.25


def best_scores(
    units: DataFrame | None, queries: DataFrame, k: int, key: str = "pos", text: Column | str = "text", query: str = "query_id", query_text: str = "query_text", k1: float = K.K1, b: float = K.B,
    keep: Sequence[str] = (), allowed: DataFrame | None = None, postings: DataFrame | None = None, factor: Column | None = None, where: Column | None = None, per_doc: bool = False, statistics: tuple[int, float, DataFrame] | None = None,
) -> DataFrame:
    """What scores() gives, times ``factor`` (of the columns ``keep``, positive), for all units that can be among a query's k best, ties in the order of ``key``, and for few others. where: a condition on ``keep`` that units must meet. per_doc: with ``allowed``, also the best of each document of a query. statistics: units, mean length and (token, df) of an index that keeps them; else they are counted from the postings.

    postings: rows as of index(), or bags as of whole_bags().

    Where the queries' tokens can be broadcast, units are scanned as bags: each task scores its own to the end and passes on its best. Where they can't, postings are joined and pruned."""
    bag = materialize(token_bag(queries, query, query_text).withColumnRenamed("n", "qtf"), "bag")
    found = scanned(units, bag, k, key, text, query, k1, b, keep, allowed, postings, factor, where, per_doc, statistics)
    if found is None:
        found = pruned_scores(units, bag, k, key, text, query, k1, b, keep, allowed, postings, factor, where, per_doc, statistics)
    return found


#: Whole numbers up to here are exact as doubles; pairs of a query and a document that a table of who may have what holds.
EXACT, ALLOWED = 2**53, 1 << 22


def scanned(
    units: DataFrame | None, bag: DataFrame, k: int, key: str, text: Column | str, query: str, k1: float, b: float, keep: Sequence[str], allowed: DataFrame | None, postings: DataFrame | None,
    factor: Column | None, where: Column | None, per_doc: bool, statistics: tuple[int, float, DataFrame] | None,
) -> DataFrame | None:
    """best_scores by a scan of the units' bags; None where the queries are too many for it."""
    spark = bag.sparkSession
    pairs = bag.limit(BROADCAST_ROWS + 1).toArrow()
    may = None if allowed is None else allowed.select(query, "doc_id").filter("doc_id IS NOT NULL").limit(BROADCAST_PAIRS + 1).toArrow()
    if pairs.num_rows > BROADCAST_ROWS or (may is not None and may.num_rows > BROADCAST_PAIRS):
        return None
    asking = pairs.column(query).combine_chunks().dictionary_encode(null_encoding="encode")
    words = pairs.column("token").combine_chunks().dictionary_encode()
    docs = None if may is None else may.column("doc_id").combine_chunks().unique()
    if docs is not None and len(docs) * len(asking.dictionary) > ALLOWED:
        return None
    kept = [c for c in keep if c != key]
    kinds = (units if units is not None else postings).schema
    out = T.StructType([bag.schema[query], *[kinds[c] for c in (key, *kept)], T.StructField("score", T.DoubleType())])
    if not pairs.num_rows:
        return spark.createDataFrame([], out)
    numbered = F.broadcast(spark.createDataFrame(pa.table({"token": words.dictionary, "id": pa.array(range(len(words.dictionary)), pa.int32())})))
    made = T.StructType([*out.fields[1:-1], T.StructField("dl", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    if postings is None:
        bags = tokenized(units, key, text, kept).mapInArrow(bags_of.counting(words.dictionary, [key, *kept]), made)
    elif "tfs" in postings.columns:
        bags = postings.select(key, *kept, "dl", "tokens", "tfs").mapInArrow(bags_of.numbering(words.dictionary, [key, *kept]), made)
    else:
        some = postings.filter(~F.col("token").startswith(MARK)).join(numbered, "token").groupBy(key, *kept, "dl").agg(F.collect_list(F.struct("id", F.col("tf").cast("int").alias("tf"))).alias("p"))
        bags = some.select(key, *kept, "dl", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"))
    bags = materialize(bags, "bags")
    n_units, avgdl, known = statistics or (*corpus_stats(bags if postings is None or "tfs" in postings.columns else postings.filter(F.col("token").startswith(MARK))).first(), None)
    df = bags.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")) if known is None else known.join(numbered, "token")
    idfs = np.zeros(len(words.dictionary))
    for r in df.select("id", idf("df", F.lit(n_units)).alias("idf")).collect():  # a row a word of the queries
        idfs[r.id] = r.idf
    qtf, q = pairs.column("qtf").to_numpy(), asking.indices.to_numpy()
    word = words.indices.to_numpy()
    if np.bincount(q, qtf * idfs[word] * (k1 + 1) * 1e9 + 1).max() >= EXACT:
        return None
    grid = None
    if may is not None:
        grid = np.zeros((len(docs), len(asking.dictionary)), bool)
        asked_by = pc.index_in(may.column(query), value_set=asking.dictionary)
        named = pa.table({"q": asked_by, "d": pc.index_in(may.column("doc_id"), value_set=docs), "null": pc.is_null(may.column(query))})
        named = named.filter(pc.and_(pc.is_valid(named.column("q")), pc.invert(named.column("null"))))
        grid[named.column("d").to_numpy(), named.column("q").to_numpy()] = True
    shared = spark.sparkContext.broadcast(bags_of.Asked.of(word, q, qtf, idfs, asking.dictionary, docs, grid))
    bags = of_units(bags, [key, *kept])
    if where is not None:
        bags = bags.filter(where)
    bags = bags.filter(F.col(key).isNotNull() & (F.size("ids") > 0)).withColumn("factor", F.lit(1.0) if factor is None else factor.cast("double"))
    return bags.mapInArrow(bags_of.scoring(lambda: shared.value, bags_of.Weighing(avgdl, k1, b), k, query, [key, *kept], per_doc and grid is not None), out)


def of_units(bags: DataFrame, keys: list[str]) -> DataFrame:
    """bags with a row a unit: rows that share all of ``keys`` become one, with the length that goes with each token as ``dls``. Tables without such stay as they are."""
    shared = materialize(bags.filter(F.col(keys[0]).isNotNull()).groupBy(keys[0]).count().filter("count > 1").select(keys[0]), "shared")
    if shared.isEmpty():
        return bags
    bags = bags.withColumn("dls", F.array_repeat("dl", F.size("ids")))
    some = bags.join(small(shared), keys[0], "left_semi").groupBy(*keys).agg(F.max("dl").alias("dl"), F.collect_list(F.struct("ids", "tfs", "dls")).alias("p"))
    return bags.join(small(shared), keys[0], "left_anti").unionByName(some.select(*keys, "dl", *[F.flatten(F.col("p")[c]).alias(c) for c in ("ids", "tfs", "dls")]))


def pruned_scores(
    units: DataFrame | None, bag: DataFrame, k: int, key: str, text: Column | str, query: str, k1: float, b: float, keep: Sequence[str], allowed: DataFrame | None, postings: DataFrame | None,
    factor: Column | None, where: Column | None, per_doc: bool, statistics: tuple[int, float, DataFrame] | None,
) -> DataFrame:
    """best_scores by joins of postings.

    Each token has a bound, its highest impact on any unit. A first pass adds up the postings near their bounds alone and scores the units that lead by them; the k-th of these scores is a threshold. Tokens are taken from the highest bound down: once all bounds that are left sum up to less than the threshold, no unit that has only these can reach it, so their postings are not read for new units. Sums over the tokens before that point, and some more, plus the bounds that are left, drop most units; the rest are scored to the end. Nothing that can reach the threshold is dropped."""
    if postings is not None and "tfs" in postings.columns:
        postings = posted(postings, key, keep)
    tf, lengths = asked_postings(units, bag, key, text, keep, postings)
    n_units, avgdl, known = statistics or (*corpus_stats(lengths).first(), None)
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.greatest("dl", F.lit(1)) / F.lit(avgdl))
    share = F.col("tf") * F.lit(k1 + 1) / norm
    # rows that share a key are one unit
    units_of = tf.groupBy("token", key, *[c for c in keep if c != key]).agg(F.count("*").alias("rows"), F.sum(share).alias("share"))
    tokens = units_of.groupBy("token").agg(F.sum("rows").alias("df"), F.max("share").alias("top"), F.max("rows").alias("rows"))
    if known is not None:
        tokens = tokens.drop("df").join(known, "token")
    tokens = tokens.select("token", idf("df", F.lit(n_units)).alias("idf"), "top", "rows")
    bound = F.ceil(F.col("qtf") * F.col("idf") * F.col("top") * F.lit(1e9)).cast("bigint") + F.col("rows")
    from_here = Window.partitionBy(query).orderBy("bound", F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    asked = bag.join(tokens, "token").withColumn("bound", bound).withColumn("upto", F.sum("bound").over(from_here))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "token")))
    asked = materialize(asked, "asked")
    if where is not None:
        tf = tf.filter(where)
    tf = tf.withColumn("factor", F.lit(1.0) if factor is None else factor)
    most = 1.0 if factor is None else tf.agg(F.max("factor")).first()[0] or 1.0
    found = reaching(tf, asked, k, query, key, keep, allowed, [], share, avgdl, k1, b, most)
    if per_doc:
        each = reaching(tf, asked, 1, query, key, keep, allowed, ["doc_id"], share, avgdl, k1, b, most)
        found = found.unionByName(each).dropDuplicates([query, key])
    return found


def reaching(tf: DataFrame, asked: DataFrame, k: int, query: str, key: str, keep: Sequence[str], allowed: DataFrame | None, within: list[str], share: Column, avgdl: float, k1: float, b: float, most: float) -> DataFrame:
    """best_scores' rows for the k best of each query, or of each query and document (within: doc_id). most: the highest factor."""
    term = term_score(F.col("qtf"), F.col("idf"), F.col("tf"), F.col("dl"), F.lit(avgdl), k1, b)
    group, unit = [query, *within], [query, key, *keep, "factor"]
    score = lambda s: s / F.lit(1e9) * F.col("factor")
    on = ["token"] if allowed is None else ["token", "doc_id"]
    scoped = asked if allowed is None else asked.join(allowed, query)
    first = scoped.filter(F.col("nth") <= TOP_TOKENS)
    tops = first.select("token", F.col("top").alias("top_of_token")).distinct()
    lead = tf.join(small(tops), "token").filter(share >= F.lit(TOP_BLOCK) * F.col("top_of_token"))
    lead = lead.join(small(first), on).groupBy(*unit).agg(F.sum(term).alias("s"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(score(F.col("s")).desc(), key))
    lead = materialize(lead.withColumn("place", place).filter(F.col("place") <= CANDIDATES * k).select(*unit), "lead")
    whole = tf.join(small(lead.select(query, key)), key).join(small(asked), [query, "token"])
    whole = whole.groupBy(*unit).agg(F.sum(term).alias("s")).withColumn("score", score(F.col("s")))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), key))
    least = whole.withColumn("place", place).filter(F.col("place") == k).select(*group, F.col("score").alias("least"))
    least = materialize(least, "least")
    # bounds are of scores without the factor
    scoped = scoped.join(small(least), group, "left").fillna(0.0, ["least"])
    early = F.col("upto") / F.lit(1e9) * F.lit(most) >= F.col("least") * F.lit(LEFT_OUT)
    late = F.sum(F.when(~early, F.col("bound")).otherwise(0)).over(Window.partitionBy(*group, *([] if within or allowed is None else ["doc_id"])))
    scoped = materialize(scoped.withColumn("early", early).withColumn("late", late), "scoped")
    summed = tf.join(small(scoped.filter("early")), on).groupBy(*unit).agg(F.sum(term).alias("s"), F.first("late").alias("late"), F.first("least").alias("least"))
    left = materialize(summed.filter(score(F.col("s") + F.col("late")) >= F.col("least")), "left")
    rest = scoped.filter(~F.col("early")).select(query, *on, "qtf", "idf")
    more = tf.join(small(left.select(query, key), BROADCAST_PAIRS), key).join(small(rest), [query, *on]).select(*unit, term.alias("s"))
    out = left.select(*unit, "s").unionByName(more).groupBy(*unit).agg(F.sum("s").alias("s"))
    return out.select(query, key, *keep, score(F.col("s")).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "pos", query: str = "query_id") -> DataFrame:
    """The k best units of each query, ties in the order of the units."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
