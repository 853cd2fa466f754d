"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id and text. Words are summed by source and
leading hash digits; in each source's histogram the bucket in which its budget
ends is found, and only that bucket is split by the next digits, down to single
hashes. What a source gives is then a filter, ``hash < cut``: no row is sorted,
and a rerun takes the same rows.

Nulls: a null text has size 0, a null source is a source of its own that comes
last, a null id counts as the empty string. Very long texts count with all their
words and are taken whole. Rows that repeat both id and text share a hash, which is
the only tie there is, and are taken or left alike. An empty table gives an empty
result. Other columns, of whatever name, are carried along by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.llm.common import WORD, join_by_key, quoted, table, text_or_empty
from evisift.storage import materialize, running, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2.0
#: Bits of the hash, and of it for each level of the histogram.
BITS, STEP = 60, 15


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of the MD5 of id and text."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), text_or_empty(text_col))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("bigint")


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """(source, source_size, target): share of all words, dealt by weight; a source stops at max_repeat times its size and the rest is dealt again by weight. That is the water level L with sum(least(cap, weight * L)) = share * words, found by one pass over the sources in the order of cap / weight. Sources may be many: sums over them are made by ranges."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(s.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1)), ["none", "source"], {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    s = running(s.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "none", "source"], {"caps": "cap", "weights": "weight"})
    whole = s.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))
    s = s.crossJoin(F.broadcast(whole))  # one row
    level = (F.col("words") * F.lit(float(share)) - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    s = s.withColumn("level", level)
    first = s.filter("ratio >= level").agg(F.min(F.struct("ratio", "level"))["level"].alias("water"))
    s = s.crossJoin(F.broadcast(first))  # one row
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))).alias("target"))


def cuts(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """For sizes (source, size, h): (source, source_size, target, base, cut). A row is taken base times, and once more if h < cut. The hash at which a budget ends is in if that is nearer to the target."""
    t = targets(sizes, weights, share, max_repeat)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    t = t.withColumn("base", base).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    state = materialize(t.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("done", F.lit(0).cast("bigint")).withColumn("here", F.lit(0).cast("bigint")), "mix")
    for shift in range(BITS - STEP, -1, -STEP):
        inside = F.shiftright("h", shift + STEP) == F.col("prefix")
        open_ = state.filter("need > 0").select("source", "need", "prefix", "done")
        hist = join_by_key(sizes, open_, "source").filter(inside)
        hist = hist.groupBy("source", "need", "done", F.shiftright("h", shift).alias("digit")).agg(F.sum("size").alias("words"))
        upto = F.col("done") + F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        hist = hist.withColumn("upto", upto).filter("upto >= need").groupBy("source").agg(F.min(F.struct("digit", (F.col("upto") - F.col("words")).alias("done"), F.col("words").alias("here"))).alias("at"))
        kept = state.drop("prefix", "done", "here")
        state = kept.join(hist.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        state = state.select(*kept.columns, F.coalesce("at.digit", F.lit(0)).alias("prefix"), F.coalesce("at.done", F.lit(0)).alias("done"), F.coalesce("at.here", F.lit(0)).alias("here"))
        state = materialize(state, "mix")
    nearer = (F.col("done") + F.col("here") - F.col("need")) <= (F.col("need") - F.col("done"))
    cut = F.when(F.col("need") > 0, F.col("prefix") + nearer.cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return materialize(state.select("source", "source_size", "target", "base", cut.alias("cut")), "mix")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), row_hash(id_col, text_col).alias("h"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    slim = materialize(sized(docs), "sizes")
    out = join_by_key(slim, cuts(slim.drop("doc_id"), weights, share, max_repeat), "source")
    copies = F.col("base") + (F.col("h") < F.col("cut")).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all, once, twice ...), with docs' columns."""
    slim = materialize(sized(docs).drop("doc_id"), "sizes")
    source, base, cut, h, copies, copy = unused(docs.columns, "source", "base", "cut", "h", "copies", "copy")
    limit = cuts(slim, weights, share, max_repeat).select(F.col("source").alias(source), F.col("base").alias(base), F.col("cut").alias(cut))
    rows = join_by_key(docs.withColumn(h, row_hash()).withColumn(source, F.col("source")), limit, source)
    rows = rows.withColumn(copies, (F.col(base) + (F.col(h) < F.col(cut)).cast("bigint")).cast("int")).filter(F.col(copies) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return rows.select(*quoted(docs.columns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) AS water FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(weight * water, cap)) AS target FROM m),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
e AS (SELECT *, target - base * source_size AS need FROM n),
g AS (SELECT source, h, sum(size)::BIGINT AS here FROM d GROUP BY source, h),
c AS (SELECT source, h, here, sum(here) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (SELECT e.source, min(h) AS h FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source WHERE need > 0 AND upto >= need GROUP BY e.source),
k AS (SELECT e.*, CASE WHEN b.h IS NULL THEN 0 ELSE b.h + CASE WHEN c.upto - need <= need - (c.upto - c.here) THEN 1 ELSE 0 END END AS cut
      FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM b.source AND c.h = b.h)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN h < cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
