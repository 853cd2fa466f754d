"""The training-data operators on small tables: brute force, round trips, held-out accuracy and odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisift.llm import chat, common, mixing, multi_index, near_duplicates, quality, token_shards, topk, toxicity, urls, wfst
from evisift.llm.common import components
from evisift.llm.labelled import labelled_sample
from evisift.storage import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, label string"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def text(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, sources=None):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", sources[i] if sources else "s", 0, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ids and ties."""
    long = text(60_000, random.Random(1))
    rows = [(1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "y", "z"), (3, "a b", "en", "s", 3, "", "", ""), (3, "a b", "en", "s", 3, "", "", ""), (None, "a b c d e f", "en", "t", 1, "", "", ""), (5, long, "de", "t", 1, "", "", ""), (6, long, "de", None, 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


# 1 -----------------------------------------------------------------------------------------


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = [shingle_set(t) for _, t in rows]
    link = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((rows[i][0], least, len(link[i]), rows[i][0] == least))
    return sorted(out)


def near_texts():
    rng = random.Random(7)
    out = []
    for _ in range(8):
        base = text(rng.randint(30, 200), rng).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out + ["a b", "A  b", "", "a b c d e"]


@pytest.mark.parametrize("cell,block", [(2048, 256), (4, 3)])
def test_near_duplicates(spark, monkeypatch, cell, block):
    monkeypatch.setattr(near_duplicates, "CELL", cell)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    texts = near_texts()
    got = near_duplicates.near_duplicates(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in got) == brute_near(list(enumerate(texts)))


def test_near_duplicates_odd_rows(spark):
    got = near_duplicates.near_duplicates(odd(spark))
    assert got.count() == 7
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].n_links == 1 and by[6].class_id == 5 and not by[6].kept and by[1].n_links == 0 and by[2].kept
    left = near_duplicates.drop_near_duplicates(odd(spark))
    assert left.columns == odd(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "5", "None"]
    assert near_duplicates.near_duplicates(odd(spark).limit(0)).count() == 0


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rng = random.Random(12)
    a, b, c = (text(60, rng) for _ in range(3))
    near = a + " more"
    rows = [(3, a), (5, b), (5, a), (5, near), (5, b), (None, c), (None, c), (None, near), (9, c), (7, ""), (7, None)]
    df = spark.createDataFrame([(i, t, n, 1, 2, 3, 4) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int, k int, j int, words int, copies int")
    got = near_duplicates.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 5
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in got) == sorted([(3, 3, 3), (5, 5, 1), (5, 3, 3), (5, 3, 3), (5, 5, 1), (0, 9, 2), (0, 9, 2), (0, 3, 3), (9, 9, 2), (7, 7, 0), (7, 7, 0)])
    left = near_duplicates.drop_near_duplicates(df)
    assert left.columns == df.columns and left.filter("k <> 1 or j <> 2 or words <> 3 or copies <> 4").count() == 0
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (9, c), (7, ""), (7, None)], key=str)
    assert left.filter("doc_id = 5").first().n in (1, 4)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("evisift.llm.common.HOT", 2)
    texts = near_texts() * 2
    got = near_duplicates.near_duplicates(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in got) == brute_near(list(enumerate(texts)))


def test_join_by_key_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr("evisift.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr("evisift.llm.common.HOT", 2)
    big = spark.createDataFrame([(i, [None, "a", "b", "c", "c"][i % 5], 0) for i in range(50)], "`i.d` long, s string, size int")
    small = spark.createDataFrame([("a", 1), ("c", 3), (None, 9)], "s string, v int")
    got = common.join_by_key(big, small, "s")
    assert sorted(tuple(r) for r in got.select("`i.d`", "v", "size").collect()) == [(i, [9, 1, 0, 3, 3][i % 5], 0) for i in range(50) if i % 5 != 2]


def test_matches_needed_is_a_tail():
    need = near_duplicates.matches_needed()
    assert len(need) == 6 and all(a < b for a, b in zip(need, need[1:], strict=False)) and need[-1] < 0.8 * 96


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[60] == 50
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 2 -----------------------------------------------------------------------------------------

PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "\n", "<", "[", "[ROLE=", "]", "61]", "[/ROLE]", "x ", "é", ""]


def test_chat_round_trip():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7)))
        role = rng.choice(["user", "assistant", "system", "", "tool]", "é"])
        rendered, back, begin, end = chat.render(role, t)
        assert back == t and [x[:2] for x in chat.parse(rendered * 2)] == [(role, t)] * 2
        assert chat.escape(t) == rendered[begin:end] or t == rendered[begin:end]
    with pytest.raises(ValueError):
        chat.parse("[INST]a</s>\n")


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", "[INST] a"), (2, 0, "assistant", None), (None, 0, None, "n"), (1, 1, "assistant", "b\\")]
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(c).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 4 and got[2].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256("user\n[INST] a\nassistant\nb\\\nassistant\nb\\\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b\\b\\").hexdigest() and got[None].n_turns == 1
    whole = {r.conv_id: r for r in chat.format_conversations(c).collect()}
    assert len(whole[1].formatted) == got[1].formatted_chars and [x[1] for x in chat.parse(whole[1].formatted)] == ["[INST] a", "b\\", "b\\"]
    span = whole[1].loss_spans[0]
    assert whole[1].formatted[span.begin : span.end] == "b\\\\"
    assert chat.digests(c.limit(0)).count() == 0


def test_chat_digests_read_the_mask_and_the_joined_text(spark):
    c = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc</s>"), (1, 2, "assistant", "d")], "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(c)
    assert chat.digest_turns(turns).collect() == chat.digests(c).collect()
    good = chat.digests(c).first()
    wrong = chat.digest_turns(turns.withColumn("loss_begin", F.col("loss_begin") + 1)).first()
    assert good.loss_chars == 7 and wrong.loss_chars == 5 and wrong.loss_sha256 != good.loss_sha256
    assert chat.digest_turns(turns.withColumn("loss_begin", F.lit(None).cast("int"))).first().loss_chars == 0
    with pytest.raises(Exception, match="a turn must end its line"):
        chat.digest_turns(turns.withColumn("formatted", F.rtrim(F.regexp_replace("formatted", "\n", "")))).collect()


# 3 -----------------------------------------------------------------------------------------


def brute_segment(model, name):
    best = None
    n = len(name)
    for cut in range(1 << (n - 1)):
        pieces, last = [], 0
        for i in range(1, n + 1):
            if i == n or cut >> (i - 1) & 1:
                pieces.append(name[last:i])
                last = i
        cost = 0.0
        for k, p in enumerate(pieces):
            cost += model.cost[p] if p in model.cost else model.unknown + 2.0 * len(p)
            if k and p not in model.cost and pieces[k - 1] not in model.cost:
                cost += 1e9  # two unknown stretches are one
        best = min(best, cost) if best is not None else cost
    return best


def test_segmentation_is_the_likeliest():
    m = urls.NameModel({"casino": 5, "win": 9})
    rng = random.Random(4)
    words = ["win", "bet", "art", "now", "x", "qz", "spin", "a"]
    for _ in range(60):
        name = "".join(rng.choice(words) for _ in range(rng.randint(1, 4)))[:11]
        got = m.segment(name)
        cost = sum(m.cost[p] if p in m.cost else m.unknown + 2.0 * len(p) for p in got)
        assert "".join(got) == name and cost == pytest.approx(brute_segment(m, name))


def test_urls(spark):
    rows = ["http://WWW.Casinowin.com/a/b?x#y", "https://a.net/q", "https://m.example.net/en/1", "http://example.com/de/", "http://example.com/deutsch", "https://x.org/fr/#z", "http://net", "no scheme", None, "", "http://citylibrary.example.com/books", "//x://Y.net/"]
    got = [tuple(r)[1:5] for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("www.casinowin.com", "/a/b", None, "block")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("example.net/en/", "allow") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == (None, "allow") and got[5] == ("x.org", "/fr/", "org/fr/", "allow") and got[6] == ("net", "", None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10][3] == "allow" and got[11][:3] == ("y.net", "/", "net/")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_words_are_learnt_from_all_tokens(spark):
    rows = [(i, f"http://{h}/{i}") for i, h in enumerate(["blog.adult-x.example.org", "www.adult-x.org", "m.casinoqz.com", *["zebvaqua.example.com"] * 9, *["www.tapqiolas.org"] * 7, *["vaquazebs.org"] * 5])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    model = urls.fit_names(pages)
    assert model.counts["tapqiolas"] == 7 and model.counts["zebvaqua"] == 9 and model.counts["http"] == 24
    assert model.segment("casinotapqiolas") == ["casino", "tapqiolas"] and model.segment("casinoqz") == ["casino", "qz"]
    assert model.segment("zebvaquatapqiolas") == ["zebvaqua", "tapqiolas"] and model.words("www.blog.org", "") == ["blog"]
    assert model.segment("mountainbikeclub") == ["mountain", "bike", "club"] and model.segment("therapist") == ["therapist"]
    got = [r.verdict for r in urls.judge(pages, rules=()).orderBy("page_id").collect()]
    assert got == ["block"] * 3 + ["allow"] * 21


def test_url_words_lean_to_the_side_of_their_urls(spark):
    hosts = ["casinopoker-quvim.com"] * 30 + ["citylibrary-stelb.org"] * 30 + ["quvim.com", "stelb.org", "www.example.com"]
    pages = spark.createDataFrame([(i, f"https://{h}/p/{i}", "k") for i, h in enumerate(hosts)], "page_id long, url string, w string")
    model = urls.fit_names(pages)
    assert model.learnt["quvim"] > 1 and model.learnt["stelb"] < -1 and "example" not in model.learnt and "p" not in model.learnt
    got = [r.verdict for r in urls.judge(pages, rules=()).orderBy("page_id").collect()]
    assert got == ["block"] * 30 + ["allow"] * 30 + ["block", "allow", "allow"]


def plain_odds(model, host, path):
    """Log odds of multinomial naive Bayes with add-one smoothing over the names, and the table's words beside it."""
    labels = host.split(".")
    while len(labels) > 2 and re.fullmatch(r"www\d*|m|mobile|blogs?|amp|cdn|static|img|web", labels[0]):
        labels = labels[1:]
    labels = labels[:-1] or labels
    names = [" ".join(x).split() for x in (urls.BLOCKED, urls.ALLOWED)]
    every = set(names[0]) | set(names[1])
    total = 0.0
    for token in re.findall("[a-z]+", ".".join(labels)) + re.findall("[a-z]+", path.lower()):
        for w in model.segment(token):
            if w in every:
                total += np.log((names[0].count(w) + 1) / (len(names[0]) + len(every))) - np.log((names[1].count(w) + 1) / (len(names[1]) + len(every)))
            else:
                total += model.learnt.get(w, 0.0)
    return total


def test_url_scores_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    more = [(-1, "http://winbettingcasino.example.com/slots/free"), (-2, "https://openlibrary.org/books/history"), (-3, "http://x/" + "casino" * 2000)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string"))
    model = urls.fit_names(pages)
    for r in urls.judge(pages).join(pages, "page_id").collect():
        rest = re.split("[?#]", r.url.split("://", 1)[1])[0]
        assert (r.host, r.path) == (rest.split("/")[0].lower(), rest[len(rest.split("/")[0]) :])
        assert r.log_odds == pytest.approx(plain_odds(model, r.host, r.path))
        fits = [(len(h) + len(p), h + p, v) for h, p, v in urls.RULES if ("." + r.host).endswith("." + h) and r.path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "block" if r.log_odds > 0 else "allow")
        assert (r.rule, r.verdict) == want


# 4 and 7 -----------------------------------------------------------------------------------


def vectors(spark, n=300, dim=16, groups=12):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((groups, dim))
    rows = []
    for i in range(n):
        x = base[rng.integers(groups)] + 0.12 * rng.standard_normal(dim) if i % 3 else rng.standard_normal(dim)
        rows.append((i, [float(v) for v in x.astype(np.float32)], "x", 1))
    rows += [(1000 + i, rows[3][1], "x", 1) for i in range(5)]
    rows += [(2000, None, "x", 1), (2001, [0.0] * dim, "x", 1), (2002, [float("nan")] * dim, "x", 1), (2003, [None] + [1.0] * (dim - 1), "x", 1), (2004, [], "x", 1), (2005, [1.0, 2.0], "x", 1), (2100, [2.0, 4.0], "x", 1), (None, rows[3][1], "x", 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string, score int")


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    rows, df = vectors(spark)
    good = [(n, np.array(x, np.float64)) for n, (_, x, *_) in enumerate(rows) if x and None not in x and np.isfinite(x).all() and any(x)]
    link = {n: {m for m, y in good if len(y) == len(x) and m != n and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95} for n, x in good}
    got = {r.vec_id: r for r in multi_index.near_vectors(df).collect()}
    assert len(got) == len(rows)
    found = {n: got[rows[n][0]].n_links for n, _ in good}
    assert all(found[n] <= len(link[n]) for n in found) and sum(found.values()) >= 0.98 * sum(map(len, link.values()))
    assert {r.component_id for r in got.values() if r.n_links} <= {rows[n][0] for n in link if link[n]}
    assert got[2005].component_id == got[2100].component_id == 2005 and not got[2100].kept
    for i in (2000, 2001, 2002, 2003, 2004):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert multi_index.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("bins,queries", [(4096, 2048), (7, 2)])
def test_top_k(spark, monkeypatch, bins, queries):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "BLOCK", queries)
    rows, df = vectors(spark)
    good = [(i, np.floor(1024 * np.array(x, np.float64)).astype(np.int64)) for i, x, *_ in rows if i is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all()]
    want = []
    for i, x in good:
        if i % 100 == 0:
            best = sorted((-int(x @ y), j) for j, y in good if j != i and len(x) == len(y))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [1e5, 3e5])
def test_top_k_of_large_components(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "BINS", 64)
    rng = np.random.default_rng(8)
    x = np.floor(size * rng.standard_normal((40, 8)) * 1024) / 1024
    x[7] = x[5]
    ids = [i % 30 for i in range(40)]  # ten ids twice
    df = spark.createDataFrame([(i, v.tolist(), "r") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, row string")
    whole = [[int(np.floor(1024 * v)) for v in r] for r in x]
    want = Counter()
    for a in range(40):
        if ids[a] % 5 == 0:
            best = sorted((-sum(p * q for p, q in zip(whole[a], whole[b], strict=True)), ids[b]) for b in range(40) if b != a)[:10]
            want.update((ids[a], r + 1, j, -s) for r, (s, j) in enumerate(best))
    got = topk.top_k(df, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == want and max(s for *_, s in want) > 2**53


def test_top_k_of_scores_beyond_the_range(spark):
    df = spark.createDataFrame([(0, [1e9] * 16), (1, [1e9] * 16)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(df, F.lit(True))


def test_links_at_the_threshold(spark):
    a, b = [1.0, 0.0], [0.95, np.sqrt(1 - 0.95**2)]
    rows = [a, b, [0.95 - 1e-12, b[1]], [b[0], b[1] * (1 - 1e-12)], [-0.0, 1.0], [0.0, 2.0]]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in multi_index.near_vectors(df, recall=1.0).collect()}
    near = lambda x, y: Fraction(x[0]) * Fraction(y[0]) + Fraction(x[1]) * Fraction(y[1])
    link = lambda x, y: near(x, y) > 0 and near(x, y) ** 2 >= Fraction(0.95) ** 2 * near(x, x) * near(y, y)
    assert got == {i: sum(link(x, y) for j, y in enumerate(rows) if j != i) for i, x in enumerate(rows)}


def test_multi_sequence_visits_the_nearest_cells():
    rng = np.random.default_rng(1)
    index = multi_index.MultiIndex(rng.standard_normal((9, 3)), rng.standard_normal((7, 3)), 1)
    x = rng.standard_normal((20, 6))
    d = multi_index.distances(x[:, :3], index.first)[:, :, None] + multi_index.distances(x[:, 3:], index.second)[:, None, :]
    for n in (1, 5, 20, 63):
        got = np.take_along_axis(d.reshape(20, -1), index.cells(x, n), 1)
        assert np.allclose(got, np.sort(d.reshape(20, -1), 1)[:, :n])


# 5 and 9 -----------------------------------------------------------------------------------


def labelled(spark, kind):
    rng = random.Random(9)
    out, labels = [], []
    for i in range(1200 if kind == "toxic" else 400):
        t, y = text(rng.randint(20, 120), rng), i % 2
        if kind == "quality" and not y:
            t = " ".join(w + rng.choice(["***", "!!", "$$$"]) for w in t.split())
        if kind == "toxic" and y:
            w = t.split()
            w.insert(rng.randrange(len(w)), rng.choice(["blorgish", "blorgishly", "xblorgis", "zwackel", "zwackler"]))
            t = " ".join(w)
        out.append(t)
        labels.append((i, y if kind == "quality" else 1, y if kind == "toxic" else 0))
    labels += [(None, 1, 1), (5, None, None), (7, 1, 1)]
    return docs(spark, out), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, y = labelled(spark, "quality")
    got = quality.with_quality(d, y).select("doc_id", "score", quality.predicted().alias("p"), quality.fold("doc_id", 5).alias("f")).collect()
    held = [r for r in got if r.f == 0]
    assert len(held) > 30 and np.mean([r.p == r.doc_id % 2 for r in held]) > 0.95
    scored = quality.with_quality(odd(spark), y, "s")
    assert scored.columns == [*odd(spark).columns, "s"] and all(0 <= r.s <= 1 for r in scored.collect())


def plain_terms(t):
    """Counts of the hashed grams, one gram after another."""
    raw = t.encode("utf-8", "replace")
    kind = lambda x: "a" if x >= 128 or 97 <= x <= 122 else "\n" if x == 10 else " " if x in (9, 11, 12, 13, 32) else "0" if 48 <= x <= 57 else "A" if 65 <= x <= 90 else chr(x)
    out = np.zeros(quality.TERMS)
    for part, codes, n in ((0, [ord(kind(x)) for x in raw], 4), (quality.HALF, list(raw), 3)):
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = h << 8 | c
            out[part + (h * int(quality.MIX) % (1 << 64) >> 53)] += 1
    return out


def plain_quality(model, t):
    x = np.log1p(plain_terms(t)) * model.idf.astype(np.float64)
    x = x / np.linalg.norm(x) @ model.basis.astype(np.float64) if x.any() else np.zeros(model.basis.shape[1])
    sims = model.vectors.astype(np.float64) @ (x / np.linalg.norm(x)) if x.any() else np.zeros(len(model.vectors))
    near = sorted(range(len(sims)), key=lambda i: (-round(float(sims[i]), 5), i))[: quality.NEIGHBOURS]
    w = [max(sims[i], 0) ** 4 for i in near]
    return sum(a * model.labels[i] for a, i in zip(w, near, strict=True)) / sum(w) if sum(w) else model.base


def test_quality_against_a_plain_version(spark):
    d, y = labelled(spark, "quality")
    d = d.filter("doc_id < 200").unionByName(odd(spark).filter("doc_id <> 6 or doc_id is null")).unionByName(docs(spark, ["日本語 ÄÖ", "x" * 70_000]).withColumn("doc_id", F.col("doc_id") + 900))
    model = quality.fit_quality(d, y)
    for r in quality.with_quality(d, y).collect():
        assert r.score == pytest.approx(plain_quality(model, r.text or ""), abs=2e-3)


def test_neighbours_that_tie(monkeypatch):
    model = quality.LatentModel(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS, 2, dtype=np.float32), np.array([[1, 0]] * 5 + [[0, 1]], np.float32), np.array([1, 0, 0, 1, 1, 1], np.float32), 0.5)
    x = np.zeros((300, quality.TERMS), np.float32)
    x[:, 0] = 1
    assert set(model.score(x, 3).tolist()) == {1 / 3} and set(model.score(x, 4).tolist()) == {0.5}


def test_latent_space_is_the_leading_one():
    rng = np.random.default_rng(2)
    topic, term = np.arange(80) % 5 % 3, np.arange(quality.TERMS) % 7 % 4
    counts = (9 * (topic[:, None] == term[None, :]) + (rng.random((80, quality.TERMS)) < 0.02)).astype(np.float32)
    model = quality.LatentModel.fit(counts.copy(), np.arange(80) % 2, rank=3)
    a = np.log1p(counts) * (np.log(81 / (1 + (counts > 0).sum(0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = np.linalg.svd(a, full_matrices=False)[1][:3]
    assert np.linalg.norm(a @ model.basis, axis=0) == pytest.approx(best, rel=2e-2)


@pytest.mark.parametrize("f", [quality.with_quality, toxicity.with_toxicity])
def test_scores_of_an_empty_table(spark, f):
    _, y = labelled(spark, "quality")
    d = docs(spark, ["a"]).limit(0)
    assert f(d, y, "n").count() == 0 and f(d, y.limit(0), "n").columns == [*d.columns, "n"]


def test_quality_without_labels(spark):
    d, y = labelled(spark, "quality")
    assert {r.score for r in quality.with_quality(d.limit(3), y.limit(0)).collect()} == {0.5}


def plain_toxicity(model, t):
    """The highest mean share of the windows, word by word and subword by subword."""
    every = re.findall(r"\w+", t.lower())
    words = [w for i, w in enumerate(every) if not i or w != every[i - 1]]

    def share(w):
        raw = b"<" + w.encode() + b">"
        got = [zlib.crc32(raw) % toxicity.BUCKETS]
        for n in (3, 4, 5):
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i : i + n]:
                    h = (h * 0x100000001B3 ^ c) % (1 << 64)
                got.append((h * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % toxicity.BUCKETS)
        return sum(float(model.share[k]) for k in got) / len(got)

    if not words:
        return 1 / (1 + np.exp(-model.bias))
    s, n = [share(w) for w in words], toxicity.WINDOW
    tops = [sum(s) / max(len(s), toxicity.LEAST)] if len(s) <= n else [sum(s[k : k + n]) / n for k in [*range(0, len(s) - n, n // 2), len(s) - n]]
    return 1 / (1 + np.exp(-(model.bias + max(tops))))


def test_toxicity_against_a_plain_version(spark):
    d, y = labelled(spark, "toxic")
    d = d.filter("doc_id < 700").unionByName(odd(spark)).unionByName(docs(spark, ["ß ÄÖ 日本語", "a a a a b", "x" * 5000]).withColumn("doc_id", F.col("doc_id") + 9000))
    model = toxicity.fit_toxicity(d, y)
    got = toxicity.with_toxicity(d, y).filter("doc_id is null or doc_id % 7 = 0 or doc_id < 8 or doc_id >= 9000").collect()
    assert len(got) > 100 and len({round(r.score, 3) for r in got}) > 20
    for r in got:
        assert r.score == pytest.approx(plain_toxicity(model, r.text or ""), rel=1e-4, abs=1e-6)


def test_training_separates_and_generalises():
    texts, y = ["bad word here", "good word there"] * 4, np.array([1, 0] * 4)
    before = toxicity.SubwordModel.fit([t.split() for t in texts], y)
    odds = before.logits(texts, {})
    assert (odds[::2] > 2).all() and (odds[1::2] < -2).all()
    assert before.words(["baad"])[0] > before.words(["gooood"])[0]  # unseen misspellings lean to the words they share subwords with


def test_training_doesn_t_depend_on_threads():
    """The same model with one and four threads of BLAS."""
    code = "import sys; import numpy as np; from evisift.llm import toxicity as t; t.STEPS = 40; r = np.random.default_rng(1); x = [[str(w) for w in r.integers(0, 300, 40)] for _ in range(60)]; print(t.SubwordModel.fit(x, np.arange(60) % 2).share.tobytes().hex()[:4000])"
    out = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"OPENBLAS_NUM_THREADS": n, "OMP_NUM_THREADS": n}, capture_output=True, text=True, check=True).stdout for n in ("1", "4")]
    assert out[0] == out[1] and len(out[0]) == 4001


def test_long_texts_are_in_the_sample(spark):
    """A class that is found in very long texts alone is learnt."""
    d, y = labelled(spark, "toxic")
    long = d.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit(" "), F.array_join(F.array_repeat("text", 30), " "))).otherwise(F.col("text")))
    model = toxicity.fit_toxicity(long.filter("doc_id < 300"), y, words=256)
    assert model.bias != -np.inf and len(toxicity.thinned("a b " * 5000, 256)) == 256 and toxicity.thinned("A a b b c", 9) == ["a", "b", "c"]


def test_toxicity_settings():
    # four dimensions, 900 steps or windows of 64 words find fewer toxic texts (README)
    assert (toxicity.DIM, toxicity.STEPS, toxicity.WINDOW) == (8, 1000, 32)


def test_labels_of_other_documents_use_up_no_bound(spark):
    d = docs(spark, [text(5, random.Random(i)) for i in range(40)])
    y = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(None, 1)], "doc_id long, toxic int")
    got = labelled_sample(d, y, "toxic", F.lit(True), (15, 10)).collect()
    assert sorted(r.y for r in got) == [0] * 15 + [1] * 10 and len({r.id for r in got}) == 25


def test_toxicity(spark):
    d, y = labelled(spark, "toxic")
    got = toxicity.with_toxicity(d, y).select("doc_id", "score", toxicity.predicted().alias("p"), quality.fold("doc_id", 4).alias("f")).collect()
    held = [r for r in got if r.f == 2]
    assert len(held) > 30 and np.mean([r.p == r.doc_id % 2 for r in held]) > 0.9
    unseen = docs(spark, [text(50, random.Random(1)) + " blorgishest " + text(50, random.Random(2)), text(100, random.Random(3))])
    assert [r.score for r in toxicity.with_toxicity(unseen, y.limit(0)).collect()] == [0.0, 0.0]
    mixed = d.unionByName(unseen.withColumn("doc_id", F.col("doc_id") + 5000)).unionByName(odd(spark).withColumn("doc_id", F.col("doc_id") + 7000))
    late = {r.doc_id: r for r in toxicity.with_toxicity(mixed, y, "label").filter("doc_id >= 5000").collect()}
    assert late[5000].label >= 0.3 > late[5001].label and late[7005].label == late[7006].label and late[7001].label == late[7002].label
    assert all(0 <= r.score <= 1 for r in toxicity.with_toxicity(odd(spark), y.limit(0)).collect())


def test_windows_cover_every_word():
    for n in (1, 63, 64, 65, 96, 97, 1000):
        start = toxicity.windows(n)
        assert set().union(*(range(s, min(n, s + toxicity.WINDOW)) for s in start)) == set(range(n))


# 6 -----------------------------------------------------------------------------------------


def test_transducer_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)
    m = wfst.Transducer(wfst.Pieces.read())
    rng = random.Random(1)
    alphabet = " ab\n\té漢字😀<s>  theing" + chr(0x2581)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [text(2000, rng), "x" * 5000, " " * 50, "", "é" * 300]
    got = [np.frombuffer(x, np.int32).tolist() for x in m.encode_all(texts)]
    assert got == sp.encode(texts) == [np.frombuffer(m.encode(t), np.int32).tolist() for t in texts]
    words = sorted({w for t in texts for w in m.unit.findall(wfst.SPACE + t.replace(" ", wfst.SPACE)) if len(w) < 200})
    assert all(m.shortest(w) == p for w, p in m.paths(words))  # one by one as all together
    assert [m.decode(np.array(x, np.int32)) for x in got] == [t.replace(chr(0x2581), " ") for t in texts]
    out = wfst.encode(odd(spark))
    assert out.count() == 7 and out.filter("not round_trip").count() == 0
    back = wfst.decode(out).join(odd(spark).select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.filter("text <> coalesce(t, '')").count() == 0


def test_unigram_path_is_the_least():
    p = wfst.Pieces([None, "a", "b", "ab", "ba", "aba", wfst.SPACE], [0.0, -3.0, -3.0, -4.0, -5.0, -9.5, -2.0], {}, 0, False, True)
    m = wfst.Transducer(p)

    def best(t):
        return 0.0 if not t else min(-p.score[m.ids[t[:k]]] + best(t[k:]) for k in (1, 2, 3) if t[:k] in m.ids)

    for t in ("abab", "baba", "aabba", "abaaba"):
        ids = np.frombuffer(m.shortest(t), np.int32)
        assert "".join(p.surface[i] for i in ids) == t and -sum(p.score[i] for i in ids) == pytest.approx(best(t))


# 8 -----------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(4)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(400)]
    texts = [None if i == 7 else text(rng.randint(0, 60), rng) for i in range(400)]
    got = mixing.mix_plan(docs(spark, texts, sources)).collect()
    again = mixing.mix_plan(docs(spark, texts, sources).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 400
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken in (0, r.size, 2 * r.size)
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    total, weights, left = 1.5 * sum(size.values()), dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True)), set(size)
    want = {}
    while True:
        share = (total - sum(want.values())) / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * share > 2 * size[s]}
        if not over:
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= over
    want |= {s: weights[s] * share for s in left}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    mixed = mixing.mix(docs(spark, texts, sources))
    assert mixed.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got)


def test_mixing_many_sources(spark, monkeypatch):
    rng = random.Random(14)
    sources = [None if i % 97 == 0 else f"h{rng.randint(0, 60)}" for i in range(300)]
    d = docs(spark, [text(rng.randint(0, 40), rng) for _ in sources], sources)
    want = sorted(map(tuple, mixing.mix_plan(d).collect()))
    monkeypatch.setattr("evisift.storage.SINGLE", 10)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "HOT", 3)
    assert sorted(map(tuple, mixing.mix_plan(d).collect())) == want


def test_mixing_keeps_columns_of_any_name(spark):
    d = docs(spark, ["a b c"] * 6, ["s", "t"] * 3).withColumns({n: F.lit(n) for n in ("base", "cut", "copies", "copy", "a.b", "key")})
    got = mixing.mix(d)
    assert got.columns == d.columns and got.count() == 9 and got.filter("base <> 'base' or cut <> 'cut' or `a.b` <> 'a.b' or h <> 'y'").count() == 0


def test_mixing_odd_rows(spark):
    assert mixing.mix_plan(odd(spark)).count() == 7
    assert mixing.mix_plan(odd(spark).limit(0)).count() == 0 and mixing.mix(odd(spark).limit(0)).count() == 0
    assert mixing.mix_plan(docs(spark, ["", None])).filter("taken <> 0").count() == 0


# 10 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    image = token_shards.permute(np.arange(n), n, 5)
    assert sorted(image.tolist()) == list(range(n))
    assert n < 100 or (np.abs(np.corrcoef(image, np.arange(n))[0, 1]) < 0.2 and (image != token_shards.permute(np.arange(n), n, 6)).any())


def test_shards(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)
    rng = random.Random(6)
    texts = [text(rng.randint(0, 200), rng) for _ in range(120)] + ["", None, "x"]
    d = docs(spark, texts).repartition(3).persist()
    out = new_path(spark, "t")
    manifest = token_shards.write_shards(d, out, length=64, shard_bytes=8_000).orderBy("shard").collect()
    again = token_shards.write_shards(d, new_path(spark, "t"), length=64, shard_bytes=8_000).orderBy("shard").collect()
    assert manifest == again and token_shards.id_type(65_537).itemsize == 4
    assert len(manifest) > 2 and [r.first_slot for r in manifest] == np.cumsum([0] + [r.n_sequences for r in manifest])[:-1].tolist()
    found = {}
    for r in manifest:
        for index, ids in token_shards.read_slots(f"{out}/{r.file}", 0, r.n_sequences, 64):
            assert index not in found
            found[index] = ids
        assert token_shards.read_slots(f"{out}/{r.file}", 1, 1, 64).__next__()[1].tolist() in [x.tolist() for x in found.values()]
    stream = np.concatenate([found[i] for i in sorted(found)]).tolist()
    got, doc = [], []
    for x in stream:
        if x == sp.eos_id():
            got.append(tuple(doc))
            doc = []
        else:
            doc.append(x)
    assert not doc and Counter(got) == Counter(tuple(sp.encode(t or "")) for t in texts)
    assert sum(r.n_tokens for r in manifest) == len(stream)
    assert token_shards.write_shards(d.limit(0), new_path(spark, "t")).count() == 0
    slots = {i: r.first_slot + k for r in manifest for k, (i, _) in enumerate(token_shards.read_slots(f"{out}/{r.file}", 0, r.n_sequences, 64))}
    n = len(slots)
    assert [slots[i] for i in range(n)] == token_shards.permute(np.arange(n), n).tolist()


def test_shard_words(monkeypatch):
    with open(token_shards.MODEL, "rb") as f:
        words = token_shards.Words(f.read())
    rng = random.Random(7)
    some = [" ", " ", "a", "ing", "\n", "é", "漢", "😀", "  ", "\t", "the", "▁", ".", "</s>", "<0x0A>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["x" * 3000, "", text(500, rng)]
    want = b"".join(words.raw(words.library.encode(t)) + words.end for t in texts)
    assert words.apart and b"".join(words.encode(texts)) == want and b"".join(words.encode([])) == b""
    monkeypatch.setattr(token_shards, "PART", 50)
    monkeypatch.setattr(token_shards, "KEPT", 100)
    monkeypatch.setattr(token_shards, "LONGEST", 3)
    assert b"".join(words.encode(texts)) == want


# pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5 and corpus_pipeline.ORACLE_SQL is None
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = steps["quality classifier"](spark, d, sf)
    assert kept.columns == d.columns and ids(kept) == ids(quality.with_quality(d, labels, "q").filter("q >= 0.3"))
    once = steps["n-gram jaccard join"](spark, d, sf)
    assert ids(once) == sorted(i for i, _, _, k in brute_near([(r.doc_id, r.text) for r in d.collect()]) if k)
    mixed = steps["mixing sources to target weights"](spark, once, sf)
    assert mixed.columns == d.columns and set(ids(mixed)) <= set(ids(once))
    assert steps["sentencepiece encoding and decoding"](spark, mixed, sf).count() == mixed.count()
    clean = steps["toxicity"](spark, d, sf)
    assert clean.columns == d.columns and set(ids(clean)) <= set(ids(d)) and clean.count() > 0.8 * d.count()


def plain_mix(rows):
    """How often each of the rows (id, text, source) is taken: words in the order of their hashes until a source's target, the one at the border if that is nearer."""
    size = [len((t or "").split()) for _, t, _ in rows]
    h = [int(hashlib.md5(f"{'' if i is None else i} {t or ''}".encode()).hexdigest()[:15], 16) for i, t, _ in rows]
    whole = Counter()
    for n, (_, _, s) in zip(size, rows, strict=True):
        whole[s] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(whole, key=lambda s: (s is None, s or "")))}
    left, target, total = set(whole), {}, 1.5 * sum(size)
    while left:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share > 2 * whole[s]} or left
        target |= {s: min(2.0 * whole[s], weight[s] * share) for s in over}
        left -= over
    out = [0] * len(rows)
    for s in whole:
        mine = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: h[k])
        base = int(target[s] // whole[s]) if whole[s] else 0
        need, at = target[s] - base * whole[s], 0
        for hash_ in sorted({h[k] for k in mine}):
            same = [k for k in mine if h[k] == hash_]
            here = sum(size[k] for k in same)
            take = at + here < need or (at < need <= at + here and at + here - need <= need - at)
            for k in same:
                out[k] = base + take
            at += here
    return out


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(260):
        t, good, toxic = text(rng.randint(20, 90), rng), i % 4 != 0, i % 5 == 1
        if toxic:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blorgish", "blorgishly", "xblorgish"]))
            t = " ".join(w)
        if not good:
            t = " ".join(w + rng.choice(["***", "!!", "$$$"]) for w in t.split())
        rows.append((i, t, rng.choice(["a", "b", "c", None])))
        labels.append((i, int(good), int(toxic)))
    for i in range(40):
        n, t, s = rows[rng.randrange(260)]
        w = t.split()
        w[rng.randrange(len(w))] = "swap"
        rows.append((300 + i if i % 3 else n, " ".join(w) if i % 2 else t, s))
    rows += [(400, None, "a"), (401, "", "b"), (None, "a b c d e f g h", "a"), (402, text(30_000, rng), "c"), *rows[:3]]
    frame = spark.createDataFrame([(*r, "x", 1.5, 7, 8, "y") for r in rows], "doc_id long, text string, source string, lang string, score double, k int, base int, key string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    y = spark.read.parquet(str(tmp_path / "labels.parquet"))
    left = list(rows)
    model = quality.fit_quality(frame, y)
    scores = [plain_quality(model, t or "") for _, t, _ in left]
    assert all(abs(s - 0.3) > 5e-3 for s in scores)
    left = [r for r, s in zip(left, scores, strict=True) if s >= 0.3]
    model = toxicity.fit_toxicity(spark.createDataFrame(left, "doc_id long, text string, source string"), y)
    scores = [plain_toxicity(model, t or "") for _, t, _ in left]
    assert all(abs(s - 0.3) > 1e-4 for s in scores)
    left = [r for r, s in zip(left, scores, strict=True) if s < 0.3]
    assert len(rows) * 0.4 < len(left) < len(rows) * 0.9
    sets = [shingle_set(t) for _, t, _ in left]
    label = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    first = {}
    for k, (i, _, _) in enumerate(left):
        if sets[k]:
            first[label[k]] = min(first.get(label[k], (True, 0)), (i is None, i or 0))
    some = [[r for r, x in zip(left, label, strict=True) if x == c and (r[0] is None, r[0] or 0) == first[c]] for c in first]
    assert any(len({t for _, t, _ in c}) > 1 or len(c) > 1 for c in some)
    # of rows that repeat the class's smallest id any one may stay: the stage says which
    stage = dict(corpus_pipeline.STAGES)["n-gram jaccard join"]
    kept = [tuple(r) for r in stage(spark, spark.createDataFrame(left, "doc_id long, text string, source string"), str(tmp_path)).collect()]
    assert len(kept) == len(some) + sum(not s for s in sets)
    assert all(sum(r in kept for r in {*c}) == 1 for c in some) and all(r in kept for r, s in zip(left, sets, strict=True) if not s)
    sp = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)
    want = Counter()
    for (i, t, _), n in zip(kept, plain_mix(kept), strict=True):
        want[(i, tuple(sp.encode(t or "")))] += n
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got.collect()) == +want
    assert got.filter("not round_trip or n_tokens <> size(token_ids)").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs(spark, ["a"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
