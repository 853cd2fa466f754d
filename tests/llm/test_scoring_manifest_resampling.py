"""Language-model scores, the Merkle manifest and importance resampling against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisift.llm import context_mixing as lm
from evisift.llm import importance, merkle, multi_index
from evisift.llm.labelled import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp string, path string, gid string, token string, score double, weight string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(200)]


def text(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(n=80, seed=1):
    """Documents of a hot source and others, with nulls, an empty and a very long text, repeated rows and ids."""
    rng = random.Random(seed)
    out = [(i, text(rng.randint(1, 60), rng) + rng.choice(["", "\n", "\nÄé x\n"]), "en", rng.choice(["a", "a", "a", "b", "ß", "c"]), i) for i in range(n)]
    out += [(3, None, None, None, None), (None, "A b C", "en", None, 1), (None, "", None, "b", None), (90, "", "", "", 0), (91, text(30_000, rng), "de", "a", 5), (5, *out[5][1:]), (5, *out[5][1:]), (5, "other", "en", out[5][3], 1)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "l", "g", "p", "i", "t", 1.0, "w") for r in data], DOCS).repartition(5)


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Merkle manifest -----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    i, t, lang, source, n = r
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)])


def plain_tree(leaves):
    """The root, and of each leaf its (left, right) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(paths):
            s = at[k] - at[k] % 3
            run = level[s : s + 3]
            p.append(("".join(run[: at[k] - s]), "".join(run[at[k] - s + 1 :])))
        at, level = [a // 3 for a in at], [sha(*level[s : s + 3]) for s in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(data):
    by = {}
    for r in data:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        group = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((group, *plain_tree([plain_leaf(r) for r in group])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (group, subroot, paths), top in zip(trees, tops, strict=True):
        for r, p in zip(group, paths, strict=True):
            path = p + top
            other = (r[0], r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1], *r[2:])
            x = plain_leaf(other)
            for left, right in path:
                x = sha(left, x, right)
            out.append((r[0], plain_leaf(r), subroot, root, sha(*[a + b for a, b in path]), x, x == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_against_plain(spark, monkeypatch, tmp_path, many_partitions, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    data = rows()
    frame(spark, data).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(data)


def test_manifest_of_small_and_empty_tables(spark, many_partitions):
    for data in ([], [(1, "x", None, "s", 1)], [(i, str(i), None, str(i), i) for i in range(5)]):
        got = merkle.merkle_manifest(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect()
        assert sorted((r.doc_id, r.leaf, r.subroot, r.root) for r in got) == [x[:4] for x in plain_manifest(data)] if data else not got
    everything = merkle.merkle_manifest(frame(spark, rows()))
    assert everything.filter(~merkle.verified(F.col("leaf"), F.col("proof"), F.col("root"))).count() == 0


# Importance resampling -----------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def plain_features(t, grams=2):
    w = plain_words(t)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % importance.BUCKETS for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def plain_resample(data, target):
    s, t = Counter(b for r in data for b in plain_features(r[1])), Counter(b for x in target for b in plain_features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    out = []
    for r in data:
        f = plain_features(r[1])
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 39), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[2], x[1]))
    for k, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_against_plain(spark):
    data, target = rows(), [text(40, random.Random(9)), None, ""]
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = importance.resample(frame(spark, data), aim).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(data, target)
    assert importance.resample(frame(spark, []), aim).collect() == []
    for none in (aim.limit(0), aim.filter("text = ''")):
        got = importance.resample(frame(spark, data), none).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=str) == plain_resample(data, [])


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
@pytest.mark.parametrize("grams", [1, 2, 3])
def test_features_of_pieces(monkeypatch, size, grams):
    monkeypatch.setattr(importance, "PIECE", size)
    texts = [r[1] or "" for r in rows(20)][:24] + ["...", "one", "A" * 100 + " b c", "x\x00y÷z"]
    got = importance.Features(grams, importance.BUCKETS).buckets(texts)
    assert [sorted(g.tolist()) for g in got] == [sorted(plain_features(t, grams)) for t in texts]


# Language-model scores -----------------------------------------------------------------------


def codes_of(texts):
    n = np.zeros((lm.SYMBOLS, lm.SYMBOLS))
    for s in lm.pieces(iter(texts)):
        np.add.at(n, (np.append(lm.END, s[:-1]), s), 1)
    return lm.codes(n)


@pytest.fixture(scope="module")
def small():
    rng = random.Random(2)
    texts = [lm.lowered(text(rng.randint(1, 50), rng) + rng.choice([".", "", "\nÄ!"])) for _ in range(60)]
    codes = codes_of(texts[:30])
    counts = lm.Counts(codes, 16)
    for s in lm.pieces(iter(texts[:40])):
        counts.add(s)
    counts.flush()
    table = lm.table_of(lm.scaled(counts.n.reshape(-1, 2)))
    model = lm.Model(codes, table, lm.Mixer.fit([]), 16)
    _, bits = model.bits(lm.Stream(codes, 16), list(lm.pieces(iter(texts[40:50]))))
    model.mixer = lm.Mixer.fit([bits])
    return texts, counts, model


def test_contexts_don_t_depend_on_pieces(monkeypatch, small):
    texts, _, model = small
    whole = lm.symbols(texts)

    def contexts(size):
        stream, out = lm.Stream(model.codes, 16), []
        for k in range(0, len(whole), size):
            before, c = stream.contexts(whole[k : k + size])
            out.append(np.stack([before.astype(np.uint64), *c]))
        return np.concatenate(out, 1)

    one = contexts(8192)
    assert all((contexts(size) == one).all() for size in (1, 7, 500))
    # equal where the plain contexts are, and only there
    plain = [[], [], []]
    for t in texts:
        for i in range(len(t) + 1):
            done = t[:i].decode("latin-1")
            words = re.findall(r"[0-9a-z\x80-\xff]+", done)
            prefix = re.search(r"[0-9a-z\x80-\xff]*\Z", done)[0]
            last = (words[:-1] if prefix else words)[-1:]
            plain[0].append(done[-3:] if i >= 3 else (done, i))
            plain[1].append(prefix)
            plain[2].append((prefix, tuple(last)))
    for keys, hashes in zip(plain, one[1:], strict=True):
        assert len(set(zip(keys, hashes.tolist(), strict=True))) == len(set(keys)) == len(set(hashes.tolist()))


def test_counts_and_scores_against_plain(small):
    texts, counts, model = small
    n, stream = np.zeros_like(counts.n), lm.Stream(model.codes, 16)
    for s in lm.pieces(iter(texts[:40])):
        _, bit, slots = stream.bits(s)
        for x in slots:
            np.add.at(n, 2 * x + bit, 1)
    assert (n == counts.n).all()
    for t in texts[50:]:
        _, bit, slots = lm.Stream(model.codes, 16).bits(lm.symbols([t]))
        own, total, slope = np.zeros(4), 0.0, np.zeros(4)
        for k in range(len(bit)):
            v = [int(model.table[x[k]]) for x in slots]
            x = np.array([*[(a >> 8) / lm.STEPS for a in v], 1.0])
            z = float(x @ (model.mixer.w[(v[2] & 3) * 4 + (v[1] & 3)] + own))
            p = 1 / (1 + math.exp(-z))
            total += math.log(p if bit[k] else 1 - p)
            slope += (bit[k] - p) * x
            if (k + 1) % lm.SEGMENT == 0:
                own, slope = own + lm.RATE * slope, np.zeros(4)
        assert model.score([t])[0] == pytest.approx(total, rel=1e-4)
    assert model.score(texts[50:]) == pytest.approx([model.alone(t) for t in texts[50:]], rel=1e-5)


def test_probabilities_sum_to_one(small):
    _, _, model = small
    for start in (b"", b"a", b"abc d", b"ca. "):
        total = []
        for s in range(lm.SYMBOLS):
            length, bits = model.bits(lm.Stream(model.codes, 16), [np.append(lm.symbols([start])[:-1], s)])
            z = model.mixer.odds(bits)[int(length[:-1].sum()) :]
            total.append(-np.log1p(np.exp(-z * bits.sign[len(bits.sign) - len(z) :])).sum())
        assert np.exp(total).sum() == pytest.approx(1, abs=1e-4)


def test_long_texts_in_parts(monkeypatch, small):
    texts, _, model = small
    long = b" ".join(texts)
    whole = model.score([long])[0]
    monkeypatch.setattr(lm.Model, "AT_ONCE", 1000)
    assert model.score([texts[0], long, texts[1]])[1] == pytest.approx(whole, rel=1e-3)


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOKEN_SHARE", 0.002)  # so that some tokens are joined
    monkeypatch.setattr(lm, "TOKENS", 50)
    data = rows(300)
    docs = frame(spark, data)
    held = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    got = lm.scored(docs, ~held, slot_bits=16).collect()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", lm.lowered(t)), b""]
    learns = [r for r in data if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    c = Counter(w for r in learns for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    plain = sorted((r[0] if r[0] is not None else -1, len(t := tokens(r[1])), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r in data)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain
    score = {}
    for r in got:
        assert r.score < 0 and r.total_bits == pytest.approx(-r.score * math.log2(10))
        score.setdefault(r.doc_id, set()).add(r.score)
    assert len(score[5]) == 2  # repeated rows are scored alike
    mixed = [(1000 + r[0], "".join(random.Random(1).sample(r[1], len(r[1]))), *r[2:]) for r in data[:50]]
    other = {r.doc_id: r.score for r in lm.scored(frame(spark, data + mixed), ~held & (F.coalesce("doc_id", F.lit(0)) < 1000), slot_bits=16).collect()}
    assert sum(other[r[0]] > other[1000 + r[0]] for r in data[:50]) == 50
    assert lm.scored(frame(spark, []), ~held, slot_bits=10).collect() == []
    silent = lm.scored(frame(spark, data[:3]), F.lit(False), slot_bits=10).collect()
    assert all(r.n_known == r.train_tokens == 0 and r.score < 0 and r.base_score == 0 for r in silent)


def test_codes_and_mixer_learn_from_all_texts(spark):
    """However many there are, and however they lie; a text's own counts are left out of what it teaches the mixer."""
    texts = [*(r[1] for r in rows(300)), None, "", "ab " * 9000] * 5
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    raw = [lm.lowered(t) for t in texts]
    pairs = np.zeros((lm.SYMBOLS, lm.SYMBOLS))
    for t in raw:
        s = lm.symbols([t])
        np.add.at(pairs, (np.append(lm.END, s[:-1]), s), 1)
    codes = lm.codes(pairs)
    found = lm.fit_codes(docs.repartition(3))
    assert all((getattr(found, c) == getattr(codes, c)).all() for c in ("begin", "length", "place", "bit"))
    counts = lm.Counts(codes, 12)
    for s in lm.pieces(iter(raw)):
        counts.add(s)
    counts.flush()
    n = lm.scaled(counts.n.reshape(-1, 2))
    bits = []
    for t in raw:
        _, bit, slots = piecewise(codes, t)
        own = sum(np.bincount(2 * x + bit, minlength=n.size).reshape(n.shape) for x in slots)
        table = lm.table_of(np.maximum(n.astype(np.int64) - own, 0))
        bits.append(lm.Bits.of([table[x] for x in slots], bit))
    for b in bits:
        b.x = [(np.floor((np.rint(x * lm.STEPS) + 4) / 9) * 9 / lm.STEPS).astype(np.float32) for x in b.x]
    assert lm.fit_mixer(docs.repartition(3), codes, n, 12).w == pytest.approx(lm.Mixer.fit(bits).w, abs=1e-4)


def test_tally_without_own_counts(monkeypatch):
    """Small and long texts, together and alone, meet the cells that they meet one by one, and for little more time than scoring takes."""
    rng = random.Random(5)
    texts = [lm.lowered(text(n, rng)) for n in (0, 1, 3, 40, 900, 5000, 7, 30)] + [b"", b"x" * 40_000]
    codes = codes_of(texts)
    counts = lm.Counts(codes, 12)
    for s in lm.pieces(iter(texts)):
        counts.add(s)
    counts.flush()
    n = lm.scaled(counts.n.reshape(-1, 2))
    plain = np.zeros(2 * lm.GATES * lm.ROUNDED**3, np.int64)
    for t in texts:
        _, bit, slots = piecewise(codes, t)
        own = sum(np.bincount(2 * x + bit, minlength=n.size).reshape(n.shape) for x in slots)
        found = [lm.table_of(np.maximum(n.astype(np.int64) - own, 0))[x].astype(int) for x in slots]
        q = [((v >> 8) + 130) // 9 for v in found]
        cell = (((found[2] & 3) * 4 + (found[1] & 3)) * 29**3 + q[0] * 29**2 + q[1] * 29 + q[2]) * 2 + bit
        np.add.at(plain, cell, 1)
    for once in (lm.Cells.ONCE, 1000):
        monkeypatch.setattr(lm.Cells, "ONCE", once)
        made = lm.Cells(codes, n, 12)
        made.add(texts)
        assert (made.cells == plain).all()
    monkeypatch.undo()
    texts = [lm.lowered(text(600, rng)) for _ in range(100)]
    model, made = lm.Model(codes, lm.table_of(n), lm.Mixer.fit([]), 12), lm.Cells(codes, n, 12)
    took = []
    for f in (model.score, made.add):
        f(texts[:10])
        began = time.process_time()
        f(texts)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0]


def piecewise(codes, text):
    """Of a text's bits: no lengths, the bits, and the predictors' slots."""
    stream, got = lm.Stream(codes, 12), []
    for s in lm.pieces(iter([text])):
        got.append(stream.bits(s))
    return None, np.concatenate([g[1] for g in got]), [np.concatenate(x) for x in zip(*[g[2] for g in got], strict=True)]


# Planted neighbours of vectors ---------------------------------------------------------------


def test_planted_links_in_many_cells(spark):
    """Thousands of planted links over many cells and both codebooks: hardly one is lost, and none is false."""
    rng = np.random.default_rng(6)
    seeds = rng.standard_normal((900, 32))
    seeds /= np.linalg.norm(seeds, axis=1, keepdims=True)
    x = [s for s in seeds]
    for k, s in enumerate(seeds[:600]):
        for _ in range(1 + k % 6):
            noise = rng.standard_normal(32)
            x.append(s + noise / np.linalg.norm(noise) * rng.uniform(0.05, 0.35))
    x = np.array(x, np.float32)
    assert multi_index.words_for(len(x)) > 1
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in multi_index.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    true, found = near.sum(1), np.array([got[i] for i in range(len(x))])
    assert true.sum() > 4000 and (found <= true).all()
    assert found.sum() >= 0.95 * true.sum()
