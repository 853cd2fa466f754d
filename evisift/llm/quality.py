"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are hashed grams of the UTF-8 text: four characters by class (upper case,
lower case, digit, white space, each mark by itself) and three bytes as they
are. tf-idf rows of a bounded labelled sample are reduced by a truncated SVD;
the sample's latent vectors are broadcast, every document is folded in and
compared with all of them by exact cosine products in blocks, and the labels of
its nearest neighbours are weighted by similarity.

Similarities are rounded to DIGITS decimals, so that they don't depend on the block
they are computed in; of neighbours that tie for the last place the first rows of
the sample, in the order of ids, vote.

Nulls and empty texts have no terms: their score is the share of label 1 in the
sample. Without any labelled row every score is 0.5. Very long texts are counted in
chunks, whole. Repeated rows get equal scores. An empty table gives an empty result.
Other columns are carried along untouched, but for one named as the score, which is
replaced.
"""

from __future__ import annotations

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
SAMPLE = (1500, 1500)
HALF, RANK, NEIGHBOURS, THRESHOLD = 2048, 48, 15, 0.3
TERMS = 2 * HALF
CHUNK, BLOCK, DIGITS = 1 << 20, 256, 5


def _classes() -> np.ndarray:
    """Class of each byte: letters, digits and spaces share one each, every other ASCII mark has its own."""
    out = np.arange(256, dtype=np.uint64)
    out[128:] = ord("a")
    out[[*range(9, 14), 32]] = 32
    out[10] = 10
    out[ord("0") : ord("9") + 1] = ord("0")
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    return out


CLASS = _classes()
MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = (h << np.uint64(8)) | codes[k : len(codes) - n + 1 + k]
    return ((h * MIX) >> np.uint64(64 - 11)).astype(np.int64)  # 11 bits: HALF


def term_counts(text: str) -> np.ndarray:
    """Counts of the TERMS hashed grams of the whole text, in chunks that overlap by a gram less one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(TERMS, np.float32)
    for part, codes, n in ((0, CLASS[raw], 4), (HALF, raw.astype(np.uint64), 3)):
        for at in range(0, max(1, len(codes) - n + 1), CHUNK):
            piece = codes[at : at + CHUNK + n - 1]
            if len(piece) >= n:
                out[part : part + HALF] += np.bincount(_grams(piece, n), minlength=HALF)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class LatentModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> LatentModel:
        """counts, a float32 row a text, are overwritten."""
        n = len(labels)
        if not n:
            return cls(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
        idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        a = np.log1p(counts, out=counts)
        a *= idf
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), np.float32(1e-30))
        q = np.random.default_rng(7).standard_normal((TERMS, min(rank + 16, n))).astype(np.float32)
        for _ in range(3):  # subspace iteration for the leading right singular vectors
            q, _ = np.linalg.qr(a.T @ (a @ q))
        _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
        basis = (q @ vt.T[:, :rank]).astype(np.float32)
        return cls(idf, basis, _unit(a @ basis), labels.astype(np.float32), float(labels.mean()))

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.base)
        x = _unit(_unit(np.log1p(counts) * self.idf) @ self.basis)
        sims = np.round(x @ self.vectors.T, DIGITS)
        k = min(k, sims.shape[1])
        last = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k][:, None]
        near, ties = sims > last, sims == last
        near |= ties & (np.cumsum(ties, 1, dtype=np.int32) <= k - near.sum(1, keepdims=True))
        at = np.nonzero(near)[1].reshape(len(sims), k)
        w = np.maximum(np.take_along_axis(sims, at, 1), 0).astype(np.float64) ** 4
        total = w.sum(1)
        votes = (w * self.labels[at]).sum(1)
        return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), self.base), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most: tuple[int, int] = SAMPLE) -> LatentModel:
    """Fitted on at most ``most`` labelled rows of either class outside the held-out fold. Only their counts come to the driver."""
    sample = labelled_sample(docs, labels, label, fold("doc_id", folds) != held, most)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "y": p["y"], "c": [zlib.compress(term_counts(t).astype(np.uint32).tobytes(), 1) for t in p["text"]]})

    got = sample.mapInPandas(count, f"id {dict(sample.dtypes)['id']}, y int, c binary").toArrow()  # mostly zeros: small when compressed
    got = got.sort_by("id")  # which are unique
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    for k, c in enumerate(got["c"]):
        counts[k] = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
    return LatentModel.fit(counts, got["y"].to_numpy())


def scorer(spark: SparkSession, model: LatentModel):  # noqa: ANN201
    shared = spark.sparkContext.broadcast(model)  # SAMPLE, TERMS and RANK bound its size

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = np.empty(len(texts))
            for at in range(0, len(texts), BLOCK):
                block = texts.iloc[at : at + BLOCK]
                out[at : at + BLOCK] = shared.value.score(np.vstack([term_counts(t or "") for t in block]))
            yield pd.Series(out)

    return score


def with_quality(docs: DataFrame, labels: DataFrame, name: str = "score", text: str = "text", **fit: object) -> DataFrame:
    """docs with a column ``name``: the score of its whole text, 0 to 1."""
    return docs.withColumn(name, scorer(docs.sparkSession, fit_quality(docs, labels, **fit))(F.coalesce(F.col(text), F.lit(""))))


def predicted(score: str | Column = "score", threshold: float = THRESHOLD) -> Column:
    return ((F.col(score) if isinstance(score, str) else score) >= threshold).cast("int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", predicted().alias("predicted"))
