"""Retrieval of evidence units: boosts, document filter, one hit per document, neighbours.

Units have a global position ``pos``. Neighbours are the units before and after a
hit, also across a document's border if the document is allowed. Units may share
a unit_id: the last position stands for it, and of hits that share one the
lowest-scored stands at the best one's place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.functions import constants as K
from evisift.functions.text import searchable_text
from evisift.operators.bm25 import best_scores, index, small
from evisift.storage import materialize


@dataclass(frozen=True)
class RetrieverSettings:
    top_k: int
    boosts: dict[str, float] = field(default_factory=dict)
    ensure_per_doc: bool = False  # for queries with more than one document
    titled: bool = True  # whether the title path is searched too
    cap: int | None = None  # rows after the neighbours; top_k if None


def boost(boosts: dict[str, float], kind: str = "unit_type") -> Column:
    """What a unit's scores are multiplied by."""
    factor = F.lit(1.0)
    for unit_type, value in boosts.items():
        factor = F.when(F.col(kind) == unit_type, F.lit(float(value))).otherwise(factor)
    return factor


def boosted(scored: DataFrame, boosts: dict[str, float], kind: str = "unit_type") -> DataFrame:
    return scored.withColumn("score", F.col("score") * boost(boosts, kind))


def select_hits(scored: DataFrame, k: int, ensure_per_doc: Column | bool = False, query: str = "query_id") -> DataFrame:
    """The k hits of each query in the order of selection (``sel``): where ensure_per_doc holds, each document's best comes first, then the score decides."""
    best = F.row_number().over(Window.partitionBy(query, "doc_id").orderBy(F.desc("score"), "pos")) == 1
    flag = F.lit(ensure_per_doc) if isinstance(ensure_per_doc, bool) else ensure_per_doc
    rows = scored.withColumn("first", flag & best)
    sel = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("first"), F.desc("score"), "pos"))
    return rows.withColumn("sel", sel).filter(F.col("sel") <= k)


def expand_neighbours(hits: DataFrame, units: DataFrame, allowed: DataFrame | None, cap: int, query: str = "query_id") -> DataFrame:
    """Hits and their neighbours, best first, at most ``cap`` a query: (query, unit_id, doc_id, pos, score, rank, is_neighbour). A neighbour scores a tenth less than its hit, 0.01 at least; the first hit that brings it counts. allowed: (query, doc_id), None for all."""
    hits = materialize(hits, "hits")  # a handful a query; units are read for them alone
    last = units.select("unit_id", "pos").join(small(hits.select("unit_id").distinct()), "unit_id", "left_semi").groupBy("unit_id").agg(F.max("pos").alias("at"))
    found = hits.groupBy(query, "unit_id").agg(F.min("sel").alias("order"), F.max_by(F.struct("doc_id", "pos", "score"), "sel").alias("h"))
    found = found.select(query, "unit_id", "h.doc_id", "h.pos", "h.score", F.col("order"), F.lit(0).alias("side"), F.lit(False).alias("is_neighbour"))
    around = hits.select(query, "unit_id", "score", "sel").join(last, "unit_id")
    around = around.select(query, "score", "sel", F.explode(F.array(F.struct(F.lit(-1).alias("d")), F.struct(F.lit(1).alias("d")))).alias("o"), "at")
    around = around.select(query, F.greatest(F.col("score") - F.lit(K.NEIGHBOUR_DECAY), F.lit(K.NEIGHBOUR_FLOOR)).alias("score"), F.col("sel").alias("order"), F.col("o.d").alias("side"), (F.col("at") + F.col("o.d")).alias("pos"))
    around = materialize(around, "around")
    near = units.select("pos", "unit_id", "doc_id").join(small(around), "pos")
    if allowed is not None:
        near = near.join(allowed, [query, "doc_id"], "left_semi")
    near = near.join(found.select(query, "unit_id"), [query, "unit_id"], "left_anti")
    once = F.row_number().over(Window.partitionBy(query, "unit_id").orderBy("order", "side"))
    near = near.withColumn("r", once).filter("r = 1").select(query, "unit_id", "doc_id", "pos", "score", "order", "side", F.lit(True).alias("is_neighbour"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "is_neighbour", "order", "side"))
    out = found.unionByName(near).withColumn("rank", rank).filter(F.col("rank") <= cap)
    return out.select(query, "unit_id", "doc_id", "pos", "score", "rank", "is_neighbour")


#: Columns of units that scores are filtered and boosted by.
KEPT = ("doc_id", "unit_type")


def searched(settings: RetrieverSettings) -> Column:
    return searchable_text("title_path", "text") if settings.titled else F.col("text")


def unit_index(units: DataFrame, settings: RetrieverSettings) -> DataFrame:
    """The postings of units, to be kept beside them; search() takes them from there."""
    return index(units, text=searched(settings), keep=KEPT)


def search(units: DataFrame, queries: DataFrame, settings: RetrieverSettings, query: str = "query_id", postings: DataFrame | None = None) -> DataFrame:
    """Evidence of each query (query_id, query_text, doc_ids array<string>): expand_neighbours' columns with the units' title_path, text and metadata. Only units of a query's documents are scored for it; units themselves are read for the hits alone."""
    allowed = materialize(queries.select(query, F.explode("doc_ids").alias("doc_id")).distinct(), "allowed")
    scored = best_scores(units, queries.select(query, "query_text"), settings.top_k, text=searched(settings), query=query, keep=KEPT, allowed=allowed, postings=postings, factor=boost(settings.boosts), per_doc=settings.ensure_per_doc)
    flag: Column | bool = False
    if settings.ensure_per_doc:
        many = allowed.groupBy(query).agg((F.count("*") > 1).alias("many"))
        scored = scored.join(small(many), query)
        flag = F.col("many")
    hits = materialize(select_hits(scored, settings.top_k, flag, query), "hits")
    hits = units.select("pos", "unit_id").join(small(hits), "pos")
    out = materialize(expand_neighbours(hits, units, allowed, settings.cap or settings.top_k, query), "found")
    return units.select("pos", "unit_type", "title_path", "text", "metadata").join(small(out), "pos")
