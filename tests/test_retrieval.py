from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from evisift.operators import automaton, bm25, keywords
from evisift.operators.keywords import contained, first_contained
from evisift.operators.retrieval import expand_neighbours, select_hits
from evisift.operators.segments import MaintainedIndex
from evisift.plans import queries


def test_bm25(spark):
    units = spark.createDataFrame([(0, "a b"), (1, "a a c"), (2, "")], "pos long, text string").filter("pos < 2")
    queries = spark.createDataFrame([(1, "a c c")], "query_id long, query_text string")
    got = {r.pos: r.score for r in bm25.scores(units, queries).collect()}
    assert got[0] == pytest.approx(0.200353, abs=1e-6) and got[1] == pytest.approx(1.516557, abs=1e-6)


def test_idf_is_positive(spark):
    assert spark.range(1).select(bm25.idf(F.lit(5), F.lit(5))).first()[0] == pytest.approx(math.log(1 + 0.5 / 5.5))


def hits_of(spark, units, scores, k, per_doc, cap):
    u = spark.createDataFrame(units, "pos long, unit_id string, doc_id string")
    s = spark.createDataFrame([(1, p, float(x)) for p, x in scores.items()], "query_id long, pos long, score double").join(u, "pos")
    out = expand_neighbours(select_hits(s, k, per_doc), u, None, cap)
    return [(r.unit_id, round(r.score, 9)) for r in out.orderBy("rank").collect()]


def test_neighbours(spark):
    units = [(i, f"u{i}", "d") for i in range(5)]
    assert hits_of(spark, units, {2: 5, 4: 1}, 2, False, 2) == [("u2", 5.0), ("u1", 4.9)]


def test_one_hit_a_document_can_be_lost(spark):
    units = [(0, "A1", "A"), (1, "A2", "A"), (2, "B1", "B")]
    assert hits_of(spark, units, {0: 9, 1: 8, 2: 1}, 2, True, 2) == [("A1", 9.0), ("A2", 8.9)]


def plain(units, scores, k, per_doc, cap):
    order = sorted(scores, key=lambda p: (-scores[p], p))
    if per_doc:
        first, seen = [], set()
        for p in order:
            if units[p][2] not in seen:
                seen.add(units[p][2])
                first.append(p)
        order = first + [p for p in order if p not in first]
    order = order[:k]
    last = {u: p for p, u, _ in units}
    out = {units[p][1]: scores[p] for p in order}
    for p in order:
        for d in (-1, 1):
            n = last[units[p][1]] + d
            if 0 <= n < len(units) and units[n][1] not in out:
                out[units[n][1]] = max(scores[p] - 0.1, 0.01)
    return [(u, round(s, 9)) for u, s in sorted(out.items(), key=lambda x: -x[1])][:cap]


@pytest.mark.parametrize("seed", range(6))
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(3, 9)
    units = [(i, f"u{i if rng.random() < 0.7 else rng.randint(0, n)}", rng.choice("AB")) for i in range(n)]
    scores = {p: float(rng.choice([1, 2, 2, 5, 9])) for p in range(n) if rng.random() < 0.7}
    if scores:
        k, per_doc = rng.randint(1, 5), rng.random() < 0.5
        assert hits_of(spark, units, scores, k, per_doc, k) == plain(units, scores, k, per_doc, k)


def random_units(spark, seed, n=150):
    """Units of many lengths, with null and empty texts, and queries with words that no unit has."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    units = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 200])))]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 200]))), rng.choice("ABC"), rng.choice("xy")) for i in range(n)]
    asked = [(q, " ".join(rng.choices([*words, "never"], k=rng.choice([1, 4, 12])))) for q in range(12)] + [(12, ""), (13, None)]
    return spark.createDataFrame(units, "pos long, text string, doc_id string, kind string"), spark.createDataFrame(asked, "query_id long, query_text string")


def ranked(scored, k):
    return sorted(map(tuple, bm25.top_k(scored, k).select("query_id", "pos", "score", "rank").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_pruned_scores_keep_the_best(spark, seed):
    units, asked = random_units(spark, seed)
    k, keep = 4, ("doc_id", "kind")
    factor = F.when(F.col("kind") == "x", 1.7).otherwise(0.6)
    full = bm25.scores(units, asked, keep=keep)
    assert ranked(bm25.best_scores(units, asked, k, keep=keep), k) == ranked(full, k)
    assert ranked(bm25.best_scores(units, asked, k, keep=keep, factor=factor), k) == ranked(full.withColumn("score", F.col("score") * factor), k)
    assert ranked(bm25.best_scores(units, asked, k, keep=keep, where=F.col("kind") == "y"), k) == ranked(full.filter("kind = 'y'"), k)
    allowed = asked.select("query_id", F.explode(F.array(F.lit("A"), F.lit("C"))).alias("doc_id")).filter("query_id % 3 <> 0 OR doc_id = 'A'")
    some = bm25.scores(units, asked, keep=keep, allowed=allowed)
    best = bm25.best_scores(units, asked, k, keep=keep, allowed=allowed, per_doc=True)
    for per_doc in (True, False):
        one, two = ([tuple(r) for r in select_hits(s, k, per_doc).select("query_id", "pos", "score", "sel").collect()] for s in (some, best))
        assert sorted(one) == sorted(two)
    assert bm25.best_scores(units.limit(0), asked, k).count() == 0 and bm25.best_scores(units, asked.limit(0), k).count() == 0


def test_pruning_drops_most(spark):
    """Of the units that share a token with a query a part alone is scored to the end."""
    units, asked = random_units(spark, 7, 600)
    asked = asked.filter("query_id < 12")
    assert bm25.best_scores(units, asked, 3).count() < 0.3 * bm25.scores(units, asked).count()


@pytest.mark.parametrize("bound", ["BROADCAST_ROWS", "BROADCAST_PAIRS", "ALLOWED", "EXACT", None])
def test_scan_and_joins_find_the_same(spark, monkeypatch, bound):
    """A scan passes on each task's best alone, without a shuffle; joins stand in for it where it can't be had, also where rows share a key."""
    units, asked = random_units(spark, 11)
    units = units.repartition(3).unionByName(units.filter("pos < 30").withColumn("pos", F.col("pos") + 1000))  # ties
    units = units.unionByName(units.limit(1).select(F.lit(None).cast("long").alias("pos"), "text", "doc_id", "kind"))
    asked = asked.unionByName(spark.createDataFrame([(20, "w1 w1 w1 w2 w2"), (21, "w1")], asked.schema))
    allowed = asked.selectExpr("query_id", "explode(array('A', 'C', 'D', null)) AS doc_id").filter("query_id % 3 <> 0 OR doc_id = 'A'")
    how = {"keep": ("doc_id", "kind"), "allowed": allowed, "factor": F.when(F.col("kind") == "x", 1.7).otherwise(0.6), "per_doc": True}
    found = [bm25.best_scores(units, asked, 3), bm25.best_scores(units, asked, 3, **how)]
    assert all("Exchange" not in f._jdf.queryExecution().executedPlan().toString() for f in found)
    if bound:
        monkeypatch.setattr(bm25, bound, 5)
    else:
        units = units.unionByName(spark.createDataFrame([(7, "w1 w1 w3", "A", "x")], units.schema))
        found = [bm25.scores(units, asked), bm25.scores(units, asked, keep=("doc_id", "kind"), allowed=allowed).withColumn("score", F.col("score") * how["factor"])]
    other = [bm25.best_scores(units, asked, 3), bm25.best_scores(units, asked, 3, **how)]
    assert ranked(other[0], 3) == ranked(found[0], 3)
    one, two = ([tuple(r) for r in select_hits(s, 3, True).select("query_id", "pos", "score", "sel").collect()] for s in (found[1], other[1]))
    assert sorted(one) == sorted(two) and one


def test_maintained_index(spark, tmp_path):
    units, asked = random_units(spark, 5)
    kept = MaintainedIndex(spark, f"file://{tmp_path}/index", keep=("doc_id", "kind"))
    assert kept.versions() == [] and kept.segments() == []
    kept.change(units.filter("pos < 80"))
    kept.change(units.filter("pos >= 70"), spark.range(0, 20).select(F.col("id").alias("pos")))
    again = units.filter("pos between 30 and 50").withColumn("text", F.lit("w1 w2 w2"))
    kept.change(again)
    final = units.filter("pos >= 20 AND NOT pos between 30 and 50").unionByName(again)

    def equal():
        now = kept.statistics()
        lengths = bm25.corpus_stats(bm25.unit_lengths(final)).first()
        df = bm25.document_frequencies(bm25.term_frequencies(final))
        assert (now.n_units, now.avgdl) == (lengths.n_units, lengths.avgdl) and sorted(map(tuple, now.df.collect())) == sorted(map(tuple, df.collect()))
        got = bm25.best_scores(None, asked, 5, keep=("doc_id", "kind"), postings=kept.postings(), statistics=(now.n_units, now.avgdl, now.df))
        assert ranked(got, 5) == ranked(bm25.scores(final, asked), 5) == ranked(bm25.scores(None, asked, postings=kept.postings()), 5)

    equal()
    # a row a unit: no change joins or copies postings
    bags = kept.bags()
    assert bags.count() == final.count()
    assert ranked(bm25.best_scores(None, asked, 5, postings=bags), 5) == ranked(bm25.scores(final, asked), 5)
    before = kept.versions()
    with pytest.raises(Exception, match="exist"):  # another change was first
        kept.commit(before[:-1], [])
    kept.compact()
    equal()
    assert len(kept.segments()) == 1 and len(kept.vacuum()) == 3 and len(kept.versions()) == 1
    equal()
    version = kept.sync(final)
    assert version == kept.sync(final) == kept.versions()[-1] and len(kept.versions()) == 1  # nothing to do
    final = final.filter("pos % 7 <> 0").withColumn("kind", F.when(F.col("pos") == 101, "z").otherwise(F.col("kind"))).unionByName(spark.createDataFrame([(500, "w3 new", "A", "x")], units.schema))
    kept.sync(final)
    equal()
    assert {r.pos: r.kind for r in kept.postings().filter("pos in (101, 500)").select("pos", "kind").distinct().collect()} == {101: "z", 500: "x"}


def test_answers_follow_from_the_evidence(spark):
    asked = queries.benchmark_questions(spark, "/root/testdata/sf0.001").limit(4)
    units = queries.docs_and_questions(spark, "/root/testdata/sf0.001")[0]
    got, none = ({r.qid: r for r in queries.judged(asked, u).collect()} for u in (units, units.limit(0)))
    assert all(got[q].evidence and not none[q].evidence and got[q].reasoning_summary != none[q].reasoning_summary for q in got)


def test_keywords_as_a_table(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choices("ab é甲.", k=rng.choice([0, 2, 9, 60])))) for i in range(60)] + [(60, None), (61, "x" * 3), (61, "yyyy")]
    words = [("".join(rng.choices("ab é甲.", k=rng.choice([1, 2, 3, 4, 7]))), p) for p in range(200)] + [("never", 200), ("", 201), (None, 202), ("yyyy", 203), ("yyyy", 204)]
    t, k = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(words, "keyword string, place long")
    plain = {(i, p) for i, x in texts for w, p in words if x and w and w in x}
    assert {(r.id, r.place) for r in contained(t, k, "id").collect()} == plain
    first = {i: min(p for j, p in plain if j == i) for i, _ in plain}
    assert {r.id: r.value for r in first_contained(t, k.withColumn("value", F.col("place")), "id").collect()} == first
    assert contained(t, k.limit(0), "id").count() == 0


def test_counts_of_shared_and_missing_keys(spark):
    """Rows that share a key, or have none, are added up; without such no posting is shuffled."""
    units = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, "b"), (None, "c"), (None, "c c"), (3, None)], "pos int, text string")
    assert sorted(map(tuple, bm25.term_frequencies(units).collect()), key=str) == [(1, "a", 3), (1, "b", 1), (2, "b", 1), (None, "c", 3)]
    plan = bm25.term_frequencies(units.filter("pos > 1"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_grams_are_taken_in_one_pass(spark):
    """Also around characters beyond the basic plane."""
    texts = spark.createDataFrame([(1, "ab😀cd e\nf"), (2, "xyz"), (3, "😀"), (4, None), (5, "")], "k int, text string")
    words = spark.createDataFrame([("b😀cd",), ("😀",), ("e\nf",), ("yz",), ("cdx",)], "keyword string")
    assert sorted(map(tuple, contained(texts, words, "k").select("k", "keyword").collect())) == [(1, "b😀cd"), (1, "e\nf"), (1, "😀"), (2, "yz"), (3, "😀")]
    plan = keywords.texts_grams(texts, "k", "text", [2, 4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "sequence(" not in plan


def test_keywords_are_scanned_for(spark, monkeypatch):
    """By automata, in one block or more, what grams find; no pair of a text and a keyword is a row."""
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("ab é甲.", k=rng.choice([0, 2, 9, 60, 300])))) for i in range(40)] + [(7, "ab aab"), (None, "ab"), (None, "b"), (50, None), (51, ""), (52, "zz")]
    words = sorted({"".join(rng.choices("ab é甲.", k=rng.choice([1, 2, 3, 4, 7]))) for _ in range(80)} | {"never", "a", "aa", "ab", "aab", "baab"})
    t, k = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w, 7 * p % 101) for p, w in enumerate(words)], "keyword string, place long")
    places = {w: 7 * p % 101 for p, w in enumerate(words)}
    hits = [(i, w) for i, x in texts for w in words if x and w in x]
    plain = {i: (sum(j == i for j, _ in hits), min((w for j, w in hits if j == i), key=places.get)) for i, _ in hits}
    for block in (keywords.BLOCK, 300, 1):  # one, several, too many: by grams
        monkeypatch.setattr(keywords, "BLOCK", block)
        got = keywords.tally(t, k, "id")
        assert {r.id: (r.n, r.first) for r in got.collect()} == plain
        assert {(r.id, r.keyword) for r in contained(t, k, "id").collect()} == {(i, w) for i, w in hits if i is not None}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (block == 1) and min(plan.count("MapInArrow"), 2) == {1: 0, 300: 2}.get(block, 1)
    assert keywords.tally(t, k.limit(0), "id").count() == 0


def test_keyword_table_counts_rows_and_cuts_as_its_sql(spark, tmp_path):
    """Rows that share a document's id, or have none, count each; a vertical tab is no space to DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    docs = [(1, "alpha beta"), (1, "alpha"), (2, "a\x0bb"), (2, "gamma"), (None, "beta"), (3, "delta"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha, beta. a\x0bb gam\tbeta"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.keyword_table(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(queries.ORACLES["keyword_table"]).fetchall(), key=str)
    assert {r.doc_id: r.n_keywords for r in got} == {1: 3, 2: 2, None: 1}


def test_finder_forgets_but_finds(monkeypatch):
    """Also when what it keeps of pieces is full, where pieces are longer than a window, and where words have every byte."""
    monkeypatch.setattr(automaton, "KEPT", 2000)
    monkeypatch.setattr(automaton, "AT_ONCE", 300)
    rng = random.Random(5)
    for letters in (b"ab c", b"a", bytes(range(256))):
        words = list({bytes(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 90]))) for _ in range(300)} | ({bytes([b]) for b in letters} if len(letters) > 4 else set()))
        find = automaton.Finder(words)
        for _ in range(5):
            texts = [bytes(rng.choices(letters + b" ", k=n)) for n in (0, 1, 3, 40, 1000)] + [rng.choice(words) + b"a" + rng.choice(words)]
            assert [f.tolist() for f in find(texts)] == [[i for i, w in enumerate(words) if w in t] for t in texts]
            assert find([]) == []  # what is kept goes before the next texts
            assert all(len(p) <= automaton.LONGEST for p in find.known) and find.room > 2000 - 150 * 400
    assert [f.tolist() for f in automaton.Finder([b"ab"])([b"b a", b""])] == [[], []]
