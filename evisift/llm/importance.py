"""Importance resampling towards a target: bags of hashed n-grams, gains by bucket, Gumbel noise.

Within a partition DuckDB takes the texts of a block of rows apart in SQL: words are
unnested, a window joins each to the next ones, and a registered function hashes the
n-grams by zlib's CRC. What a row gives, the buckets of its features, is spilled to
Parquet in the shared folder, and so are the sums by bucket, one row of them a
partition. Spark merges these, makes the buckets' gains of them and scores the spilled
rows; no text is read twice.

Documents are drawn by the highest scores. A histogram of the scores, which are
integers, gives the one at which the draw ends; only what reaches it is sorted, by
ranges, so that no task sees all rows.

Nulls and texts without a word have no feature and the weight 0; a null id counts as the
empty string in the noise and comes first among ties. Very long texts are taken apart in
pieces of PIECE characters that overlap by the n-grams that cross them. Rows that repeat
an id have the same noise; ties between them go to the smaller weight, then to fewer
features; rows that agree in all get neighbouring ranks. An empty table gives an empty
result, an empty target gains that favour rare buckets. Other columns, of whatever
name, are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import table
from evisift.storage import materialize, running

BUCKETS, GRAMS, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: Characters of the pieces of a long text; of the texts that DuckDB takes apart at once.
PIECE, BLOCK = 1 << 20, 2 << 20
SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _folded() -> np.ndarray:
    """Of each byte: A-Z as a-z, digits and what is not ASCII as they are, all others as a space."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalnum() else 32
    return out


FOLDED = _folded()


def folded(texts: list[str]) -> pa.Array:
    """Texts in which single spaces and more stand between the words."""
    a = pa.array(texts, pa.large_string())
    _, offsets, data = a.buffers()
    data = pa.py_buffer(FOLDED[np.frombuffer(data, np.uint8)]) if data is not None else None
    return pa.Array.from_buffers(a.type, len(a), [None, offsets, data])


def crc(features: pa.Array) -> pa.Array:
    """zlib's CRC of the features' UTF-8 bytes."""
    a = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    raw = a.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return pa.array(np.fromiter((zlib.crc32(b) if b is not None else 0 for b in raw), np.uint32, len(raw)))


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in parts that are cut before a separator, so that no word is divided."""
    at = 0
    while len(text) - at > size:
        cut = SEPARATOR.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def sql(grams: int, buckets: int) -> str:
    """Features of ``texts`` (row, lead, text): of the n-grams those that end behind the first ``lead`` words, which the piece before has too."""
    joined = ["word"]
    for n in range(1, grams):
        joined.append(f"{joined[-1]} || ' ' || lead(word, {n}) OVER here")
    ends = ", ".join(f"{{'f': {g}, 'last': pos + {n}}}" for n, g in enumerate(joined))
    return f"""
    WITH split AS (SELECT row, lead, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM texts),
    words AS (SELECT row, lead, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
    runs AS (SELECT row, lead, unnest([{ends}]) AS g FROM (SELECT *, lead(word) OVER here FROM words WINDOW here AS (PARTITION BY row ORDER BY pos)) WINDOW here AS (PARTITION BY row ORDER BY pos))
    SELECT row, (crc(g.f) % {buckets})::UINTEGER AS bucket FROM runs WHERE g.f IS NOT NULL AND g.last > lead
    """


class Features:
    """DuckDB's side of a partition."""

    def __init__(self, grams: int, buckets: int) -> None:
        self.con = duckdb.connect(":memory:", config={"threads": "1"})
        self.con.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow", null_handling="special")
        self.sql = sql(grams, buckets)
        self.grams = grams

    def buckets(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the buckets of its features, repeats included."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        rows, leads, held = [], [], []

        def flush() -> None:
            if not held:
                return
            self.con.register("texts", pa.table({"row": pa.array(range(len(rows)), pa.int32()), "lead": pa.array(leads, pa.int32()), "text": folded(held)}))
            got = self.con.sql(self.sql).to_arrow_table()
            row, bucket = got["row"].to_numpy(), got["bucket"].to_numpy()
            order = np.argsort(row, kind="stable")
            for r, b in zip(rows, np.split(bucket[order], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1]), strict=True):
                found[r].append(b)
            for x in (rows, leads, held):
                x.clear()

        for r, text in enumerate(texts):
            last: list[str] = []
            for piece in pieces(text, PIECE):
                rows.append(r)
                leads.append(len(last))
                held.append(" ".join([*last, piece]))
                if len(piece) < len(text):
                    last = [*last, *filter(None, SEPARATOR.split(piece))]
                    last = last[max(0, len(last) - self.grams + 1) :]
                if sum(map(len, held)) > BLOCK:
                    flush()
        flush()
        return [np.concatenate(f) if f else np.zeros(0, np.uint32) for f in found]


def spilled(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' ids and features in the shared folder: a row a document (doc_id, n_features, buckets), and a row a partition with ``sums``, the count of each bucket."""
    id_kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums, schema = Features(grams, buckets), np.zeros(buckets, np.int64), None
        for b in batches:
            schema = pa.schema([pa.field("doc_id", b.schema.field(0).type), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                got = features.buckets([t or "" for t in part.column(1).to_pylist()])
                n = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.concatenate(got) if got else np.zeros(0, np.uint32)
                sums += np.bincount(flat, minlength=buckets)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, pa.nulls(len(n), pa.list_(pa.int64()))], schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), pa.array([0], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([sums.tolist()], pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(take, f"doc_id {id_kind}, n_features long, buckets array<int>, sums array<long>"), "features")


def merged(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): the partitions' sums, added."""
    sums = rows.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("bucket", "n"))
    return sums.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: a thousand times the log of the target's smoothed share by that of docs, floored."""
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(merged(docs, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = both.crossJoin(F.broadcast(both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))))  # one row
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean of the gains of a document's features."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    id_kind = dict(rows.dtypes)["doc_id"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            n = b.column("n_features").to_numpy()
            upto = np.append(0, np.cumsum(shared.value[lists.flatten().to_numpy()]))
            ends = np.cumsum(n)
            weight = (upto[ends] - upto[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_features"), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return rows.filter("buckets IS NOT NULL").select("doc_id", "n_features", "buckets").mapInArrow(weigh, f"doc_id {id_kind}, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise of an id, a thousand times, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, able: Column, share: int = SHARE) -> DataFrame:
    """scored (doc_id, n_features, weight, score) with the rank of the rows drawn: of those that are ``able`` to be, the floored share of a hundred with the highest scores."""
    rows = materialize(scored.withColumn("able", able), "scored")
    counts = rows.filter("able").groupBy("score").agg(F.count("*").alias("n"))
    counts = running(counts.withColumn("down", -F.col("score")), ["down"], {"before": "n"})
    take = (rows.filter("able").count() * share) // 100
    last = counts.filter((F.col("before") < take) & (F.col("before") + F.col("n") >= take)).select("score").first()
    if last is None:
        return rows.drop("able").withColumn("rank", F.lit(None).cast("long"))
    near = F.col("able") & (F.col("score") >= last[0])
    high = rows.filter(near).withColumn("down", -F.col("score")).withColumn("one", F.lit(1).cast("long"))
    high = running(high, ["down", "doc_id", "weight", "n_features"], {"before": "one"})
    rank = F.when(F.col("before") < take, F.col("before") + 1)
    high = high.withColumn("rank", rank.cast("long"))
    return rows.filter(~near).withColumn("rank", F.lit(None).cast("long")).drop("able").unionByName(high.select("doc_id", "n_features", "weight", "score", "rank"))


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs (doc_id, text); target has texts."""
    rows = spilled(docs, grams, buckets)
    aim = spilled(target.withColumn("doc_id", F.lit(0)).select("doc_id", "text"), grams, buckets)
    gain = np.zeros(buckets, np.int64)
    for r in gains(rows, aim, buckets).collect():  # a row a bucket
        gain[r.bucket] = r.gain
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(seed=seed))
    # w words have w + (w - 1) + ... features
    least = sum(max(0, least_words - n) for n in range(grams))
    return drawn(scored, F.col("n_features") >= least, share)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


ORACLE = r"""
WITH t AS (
  SELECT TRUE AS doc, doc_id, row_number() OVER () AS k, text FROM documents UNION ALL SELECT FALSE, NULL, -row_number() OVER (), text FROM benchmark),
w AS (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
f AS (SELECT doc, k, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f FROM w),
c AS (SELECT doc, k, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)),
b AS (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM u),
g AS (SELECT doc, k, bucket, n FROM c JOIN b USING (f)),
s AS (SELECT r.bucket, coalesce(sum(n) FILTER (WHERE doc), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT doc), 0) AS t FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN g USING (bucket) GROUP BY r.bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE)))::BIGINT AS gain FROM s),
m AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM g JOIN gain USING (bucket) WHERE doc GROUP BY k),
x AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (k) WHERE doc),
y AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS r, floor(25 * count(*) FILTER (WHERE n_features >= 39) OVER () / 100) AS take FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND r <= take THEN r END::BIGINT AS rank FROM z
"""
