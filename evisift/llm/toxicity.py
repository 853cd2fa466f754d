"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed byte n-grams (with word ends marked) and of the
word itself; its vector is their mean, a text's the mean over its words, and a
softmax over two classes stands on that. Embeddings and softmax are trained
jointly in numpy on a bounded labelled sample, so that an unseen misspelling
shares most of its grams' vectors with the word it comes from.

As the model is linear in the words, a word's share of the decision is one
number, which scoring keeps for words it has met. The whole text is scored by
overlapping windows of its words; the highest window decides, so that length
does not dilute a passage.

Nulls and empty texts have no words: their score is that of the bias alone.
Without labelled rows of both classes every score is 0. Very long texts are scored
whole; in the sample a text of more than ``words`` words stands by runs of RUN words,
evenly spread from its beginning to its end, which bounds what the driver holds.
Repeated rows get equal scores; words that tie need no order. An empty table gives an empty result. Other columns are carried along
untouched, but for one named as the score, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import table
from evisift.llm.labelled import fold, labelled_sample

#: Labelled rows of class 0 and of class 1 that the model is fitted on, at most.
SAMPLE = (2500, 1000)
#: Words that a text of the sample gives, at most, and those of each run that a longer one is cut to.
WORDS, RUN = 8192, 128
#: Models that are averaged: being linear, they make one.
SEEDS = (11, 12, 13)
#: Passes over the sample: as many as make STEPS batches; in the first tenth windows are drawn at random.
BUCKETS, DIM, STEPS, BATCH, RATE, SCALE = 1 << 16, 8, 1000, 64, 0.5, 20.0
GRAMS, THRESHOLD = (3, 4, 5), 0.3
#: Words of a window; of the shortest text that counts as it is. A word that follows itself counts once.
WINDOW, LEAST = 32, 16
#: Words whose share is kept by a worker, at most; then it starts anew.
KEPT = 250_000
TOKEN = re.compile(r"\w+")


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all subwords of the words, one after another, and where each word's begin (with the end)."""
    raw = [b"<%b>" % w.encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    ids, owners = [np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BUCKETS], [np.arange(len(raw))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        same = owner[: len(codes) - n + 1] == owner[n - 1 :]
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) ^ codes[k : len(codes) - n + 1 + k]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        ids.append((h[same] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(codes) - n + 1][same])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(raw)))])


def thinned(text: str, most: int) -> list[str]:
    """A text's words, those that follow themselves once; of more than ``most`` words runs of them, evenly spread."""
    words = TOKEN.findall(text.lower())
    words = [w for w, before in zip(words, [None, *words], strict=False) if w != before]
    if len(words) <= most:
        return words
    starts = np.linspace(0, len(words) - RUN, max(1, most // RUN)).astype(int)
    return [w for s in starts for w in words[s : s + RUN]]


def windows(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin: at every half window, the last one ending with the text."""
    return np.append(np.arange(0, n - WINDOW, WINDOW // 2), max(n - WINDOW, 0))


@dataclass
class SubwordModel:
    #: Of each bucket: its vector times the difference of the two classes' weights.
    share: np.ndarray
    bias: float

    @classmethod
    def fit(cls, texts: list[list[str]], labels: np.ndarray, seeds: tuple[int, ...] = SEEDS) -> SubwordModel:
        """The mean of a model a seed. texts: their words."""
        met: dict[str, int] = {}
        seqs = [np.fromiter((met.setdefault(w, len(met)) for w in t), np.int64, len(t)) for t in texts]  # a text's words at a time
        labels = np.asarray([y for y, s in zip(labels, seqs, strict=True) if len(s)], np.int64)
        seqs = [s for s in seqs if len(s)]
        if len(np.unique(labels)) < 2:
            return cls(np.zeros(BUCKETS, np.float32), -np.inf)
        vocab = sorted(met)
        place = np.empty(len(vocab), np.int64)
        place[[met[w] for w in vocab]] = np.arange(len(vocab))
        seqs = [place[s] for s in seqs]
        grams, first = buckets(vocab)
        fitted = [cls.descend(seqs, labels, grams, first, seed) for seed in seeds]
        return cls(np.mean([m.share for m in fitted], 0).astype(np.float32), float(np.mean([m.bias for m in fitted])))

    @classmethod
    def descend(cls, seqs: list[np.ndarray], labels: np.ndarray, grams: np.ndarray, first: np.ndarray, seed: int) -> SubwordModel:
        """Joint AdaGrad descent of embeddings and softmax on the cross entropy, classes weighted alike. A text stands by one window an epoch: a random one at first, then the one that scores highest, as in scoring; clean texts by a random one too. In doubles and without BLAS, whose sums depend on its threads."""
        size = np.diff(first)
        rng = np.random.default_rng(seed)
        e = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
        u, b = (rng.random((DIM, 2)) - 0.5) / DIM, np.zeros(2)
        ge, gu, gb = np.full((BUCKETS, DIM), 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
        epochs = -(-STEPS // -(-len(labels) // BATCH))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            bags, of = [], []
            share = np.add.reduceat(np.einsum("bd,d->b", e, u[:, 1] - u[:, 0])[grams], first[:-1]) / size if epoch >= epochs / 10 else None
            for s, y in zip(seqs, labels, strict=True):
                start = windows(len(s))
                picks = set() if y and share is not None else {int(rng.choice(start))}
                if share is not None:
                    total = np.concatenate([[0.0], np.cumsum(share[s])])
                    picks.add(int(start[np.argmax(total[np.minimum(start + WINDOW, len(s))] - total[start])]))
                bags += [s[k : k + WINDOW] for k in sorted(picks)]
                of += [y] * len(picks)
            of = np.array(of)
            weight = (len(of) / (2 * np.bincount(of, minlength=2)))[of]
            order = rng.permutation(len(of))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                words = np.concatenate([bags[i] for i in pick])
                row = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
                n, w = size[words], np.bincount(row)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids, row, w = grams[np.repeat(first[words], n) + inner], np.repeat(row, n), np.repeat(SCALE / n / np.maximum(w[row], LEAST), n)
                rows_e = e[ids] * w[:, None]
                h = np.stack([np.bincount(row, rows_e[:, k], len(pick)) for k in range(DIM)], 1)
                z = np.einsum("rd,dc->rc", h, u) + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - np.eye(2)[of[pick]]) * weight[pick, None] / len(pick)
                du, db, dh = np.einsum("rd,rc->dc", h, d), d.sum(0), np.einsum("rc,dc->rd", d, u)
                met, place = np.unique(ids, return_inverse=True)  # the other buckets' gradient is 0
                de = np.stack([np.bincount(place, dh[row, k] * w, len(met)) for k in range(DIM)], 1)
                ge[met] += de**2
                e[met] -= rate * de / np.sqrt(ge[met])
                gu += du**2
                u -= rate * du / np.sqrt(gu)
                gb += db**2
                b -= rate * db / np.sqrt(gb)
        return cls(np.einsum("bd,d->b", e, u[:, 1] - u[:, 0]) * SCALE, float(b[1] - b[0]))

    def words(self, words: list[str]) -> np.ndarray:
        ids, at = buckets(words)
        return np.add.reduceat(self.share[ids], at[:-1]) / np.diff(at)

    def logits(self, texts: list[str], kept: dict[str, float]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            words = TOKEN.findall(text.lower())
            if not words:
                continue
            new = [w for w in set(words) if w not in kept]
            if len(kept) + len(new) > KEPT:
                kept.clear()
                new = list(set(words))
            if new:
                kept.update(zip(new, self.words(new).tolist(), strict=True))
            s = np.fromiter(map(kept.__getitem__, words), np.float64, len(words))
            out[i] += self.highest(s[np.append(True, s[1:] != s[:-1])])
        return out

    @staticmethod
    def highest(s: np.ndarray) -> float:
        """The highest mean of the windows; a text of few words counts as LEAST words."""
        if len(s) <= WINDOW:
            return float(s.sum()) / max(len(s), LEAST)
        total, start = np.concatenate([[0.0], np.cumsum(s)]), windows(len(s))
        return float((total[start + WINDOW] - total[start]).max()) / WINDOW

    def score(self, texts: list[str], kept: dict[str, float]) -> np.ndarray:
        if self.bias == -np.inf:  # not fitted
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(texts, kept), -50, 50)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most: tuple[int, int] = SAMPLE, words: int = WORDS) -> SubwordModel:
    """Fitted on at most ``most`` labelled rows of either class outside the held-out fold, and at most ``words`` words of each. Executors take the texts apart: their words come to the driver, compressed."""
    sample = labelled_sample(docs, labels, label, fold("doc_id", folds) != held, most)

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "y": p["y"], "w": [zlib.compress(" ".join(thinned(t, words)).encode("utf-8", "replace"), 1) for t in p["text"]]})

    got = sample.mapInPandas(take, f"id {dict(sample.dtypes)['id']}, y int, w binary").toArrow().sort_by("id")  # ids are unique
    return SubwordModel.fit([zlib.decompress(w.as_py()).decode().split() for w in got["w"]], got["y"].to_numpy())


def scorer(spark: SparkSession, model: SubwordModel):  # noqa: ANN201
    shared = spark.sparkContext.broadcast(model)  # BUCKETS bounds its size

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, float] = {}
        for texts in parts:
            yield pd.Series(shared.value.score([t or "" for t in texts], kept))

    return score


def with_toxicity(docs: DataFrame, labels: DataFrame, name: str = "score", text: str = "text", **fit: object) -> DataFrame:
    """docs with a column ``name``: the score of its whole text, 0 to 1."""
    return docs.withColumn(name, scorer(docs.sparkSession, fit_toxicity(docs, labels, **fit))(F.coalesce(F.col(text), F.lit(""))))


def predicted(score: str = "score", threshold: float = THRESHOLD) -> Column:
    return (F.col(score) >= threshold).cast("int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", predicted().alias("predicted"))
