"""Units as bags of numbered tokens, and the scan that scores them: inside tasks, in Arrow batches.

A unit's bag has the queries' tokens alone, as numbers, with their counts. All of it is
one row, so a unit is scored within its task: nothing is shuffled but each task's best.
The queries' tokens are broadcast; who calls has bounded them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms, and pairs of a query and a unit, that are added up at once.
AT_ONCE = 1 << 20


def lists(row: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Of n rows, each one's values; row: the row of each, ascending."""
    upto = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(upto, v) for v in values]


def counting(words: pa.Array | None, keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (*keys, tokens) the rows (*keys, dl, ids, tfs): the number of tokens; places in ``words`` and counts of those that are there. Without ``words`` the tokens themselves instead of ids, all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, known = placed(tokens.flatten(), words)
            row = np.repeat(np.arange(b.num_rows), dl)[ids >= 0]
            code, tf = np.unique(row * len(known) + ids[ids >= 0], return_counts=True)
            row, ids = np.divmod(code, max(len(known), 1))
            found = known.take(pa.array(ids)) if words is None else pa.array(ids, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(dl), *lists(row, b.num_rows, found, pa.array(tf, pa.int32()))], names=[*keys, "dl", "tokens" if words is None else "ids", "tfs"])

    return count


def placed(tokens: pa.Array, words: pa.Array | None) -> tuple[np.ndarray, pa.Array]:
    """Each token's place in ``words`` (-1: none), or in the tokens' own dictionary; and these words."""
    if words is None:
        coded = tokens.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    return pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64), words


def numbering(words: pa.Array, keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of bags with tokens (*keys, dl, tokens, tfs) what counting() gives with ``words``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _ = placed(b.column("tokens").flatten(), words)
            row = np.repeat(np.arange(b.num_rows), b.column("tokens").value_lengths().to_numpy(zero_copy_only=False))[ids >= 0]
            tf = b.column("tfs").flatten().filter(pa.array(ids >= 0))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], b.column("dl"), *lists(row, b.num_rows, pa.array(ids[ids >= 0], pa.int32()), tf)], names=[*keys, "dl", "ids", "tfs"])

    return number


@dataclass
class Asked:
    """What the queries ask for. begin: of each token where its pairs (q, qtf) begin; queries: the values that q numbers. docs, allowed: documents, and which query (column) may have which (row); None for all."""

    begin: np.ndarray
    q: np.ndarray
    qtf: np.ndarray
    idf: np.ndarray
    queries: pa.Array
    docs: pa.Array | None = None
    allowed: np.ndarray | None = None

    @classmethod
    def of(cls, words: np.ndarray, q: np.ndarray, qtf: np.ndarray, idf: np.ndarray, queries: pa.Array, *more: object) -> Asked:
        """words: each pair's token."""
        order = np.argsort(words, kind="stable")
        return cls(np.searchsorted(words[order], np.arange(len(idf) + 1)), q[order], qtf[order].astype(np.float64), idf, queries, *more)


@dataclass
class Weighing:
    """BM25's numbers."""

    avgdl: float
    k1: float
    b: float

    def __call__(self, idf: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """A token's share for one occurrence in a query, in the order of bm25.term_score."""
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * ((1 - self.b) + self.b * np.maximum(dl, 1) / self.avgdl))


class Best:
    """The k best rows of each group: highest score first, then smallest key."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.size, self.limit = k, [], 0, AT_ONCE // 4

    def add(self, rows: pa.Table, at: np.ndarray, q: np.ndarray, group: np.ndarray, score: np.ndarray) -> None:
        self.held.append((rows.take(pa.array(at)), q, group, score))
        self.size += len(at)
        if self.size > self.limit:
            self.cut()
            self.limit = max(self.limit, 2 * self.size)

    def cut(self) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
        """What is kept: rows, queries, scores."""
        if not self.held:
            return None
        rows = pa.concat_tables([h[0] for h in self.held])
        q, group, score = (np.concatenate([h[i] for h in self.held]) for i in (1, 2, 3))
        key = np.unique(rows.column(0).to_numpy(), return_inverse=True)[1]
        order = np.lexsort((key, -score, group))
        g = group[order]
        first = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), np.arange(len(g)), 0))
        order = order[np.arange(len(g)) - first < self.k]
        self.held = [(rows.take(pa.array(order)), q[order], group[order], score[order])]
        self.size = len(order)
        return self.held[0][0], q[order], score[order]


def slices(terms: np.ndarray, most_rows: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with AT_ONCE terms at most, unless one row has more, and at most so many rows."""
    upto, lo = np.cumsum(terms), 0
    while lo < len(terms):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right"))
        hi = min(max(hi, lo + 1), lo + most_rows)
        yield lo, hi
        lo = hi


def scoring(get: Callable[[], Asked], weigh: Weighing, k: int, query: str, keys: Sequence[str], per_doc: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (*keys, dl, ids, tfs, factor), with ``dls`` where tokens of a unit have lengths of their own, the k best of each query in this task, and with ``per_doc`` the best of each of its documents: (query, *keys, score). The first of ``keys`` is the unit's."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = get()
        n_q, n_docs = len(asked.queries), 0 if asked.docs is None else len(asked.docs)
        many = np.diff(asked.begin)
        best, each = Best(k), Best(1)
        least, least_each = np.zeros(n_q), np.zeros((n_docs, n_q)) if per_doc else None
        for b in batches:
            doc = None
            if asked.docs is not None:
                doc = pc.fill_null(pc.index_in(b.column("doc_id"), value_set=asked.docs), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                b, doc = b.take(pa.array(np.flatnonzero(doc >= 0))), doc[doc >= 0]
            rows = pa.Table.from_batches([b.select(list(keys))])
            dl, factor = b.column("dl").to_numpy(zero_copy_only=False), b.column("factor").to_numpy(zero_copy_only=False)
            size = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            ids, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
            row, upto = np.repeat(np.arange(b.num_rows), size), np.append(0, np.cumsum(size))
            each_dl = b.column("dls").flatten().to_numpy(zero_copy_only=False) if "dls" in b.schema.names else dl[row]
            share = weigh(asked.idf[ids], tf, each_dl)
            terms = np.bincount(row, many[ids], b.num_rows).astype(np.int64)
            for lo, hi in slices(terms, max(1, AT_ONCE // n_q)):
                p = slice(upto[lo], upto[hi])
                times = many[ids[p]]
                pair = np.arange(times.sum()) + np.repeat(asked.begin[ids[p]] - np.cumsum(times) + times, times)
                term = np.floor(asked.qtf[pair] * np.repeat(share[p], times) * 1e9 + 0.5)
                cell = np.repeat((row[p] - lo) * n_q, times) + asked.q[pair]
                shape = (hi - lo, n_q)
                total = np.bincount(cell, term, (hi - lo) * n_q).reshape(shape)  # sums of whole numbers below 2 ** 53 are exact
                hit = total > 0 if term.all() else np.bincount(cell, minlength=(hi - lo) * n_q).reshape(shape) > 0
                if doc is not None:
                    hit &= asked.allowed[doc[lo:hi]]
                total = np.where(hit, total / 1e9 * factor[lo:hi, None], -1.0)
                if hi - lo >= k:
                    np.maximum(least, np.partition(total, hi - lo - k, axis=0)[hi - lo - k], out=least)
                at, q = np.nonzero(hit & (total >= least))
                best.add(rows, lo + at, q, q, total[at, q])
                if per_doc:
                    np.maximum.at(least_each, doc[lo:hi], total)
                    at, q = np.nonzero(hit & (total >= least_each[doc[lo:hi]]))
                    each.add(rows, lo + at, q, doc[lo + at] * n_q + q, total[at, q])
        seen = set()
        for found in (best.cut(), each.cut()):
            if found is None:
                continue
            rows, q, s = found
            new = [i for i, unit in enumerate(zip(q.tolist(), *[c.to_pylist() for c in rows.columns], strict=True)) if unit not in seen and not seen.add(unit)]
            at = pa.array(new, pa.int64())
            out = pa.Table.from_arrays([asked.queries.take(pa.array(q)).take(at), *[rows.column(c).take(at) for c in keys], pa.array(s).take(at)], names=[query, *keys, "score"])
            yield from out.combine_chunks().to_batches()

    return score
