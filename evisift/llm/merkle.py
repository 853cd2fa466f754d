"""Merkle manifest of a dataset: a leaf a row, a tree a source, a tree over the sources, proofs.

Leaves are digests of the rows' fields. They are sorted by ranges of (source, id) and
checkpointed: that is an RDD whose partitions stay as they are, so that a partition's
number and the order in it can be relied on, whatever executors are lost. Counts by
partition and group give the place at which each partition's part of a group begins.
A partition then builds all complete aligned subtrees of its own; the nodes at its
ragged ends are shuffled by their coordinate (group, level, index), a block of up to
ARITY ** LEVELS leaves of the upper tree a task, round by round until each group has its
root. Paths go back down the same blocks and end at the partition's nodes, of which
there are some ten a partition and level; rows are joined to these alone. The tree over
the groups' roots is built the same way, as one group.

A path is an array of (left, right): the digests beside a node, joined, at each level.
A lone node of a run becomes the digest of itself and has nothing beside it.

Nulls: a field that is null is ``-``; a null id comes first in its source, a null source
before all others. Rows that repeat an id are ordered by their leaf; rows that agree in
everything share it and may change places, which changes no root. Empty texts are ``0:``;
very long ones are hashed whole. An empty table has no rows and no root. Other columns,
of whatever name, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.llm.common import table
from evisift.storage import materialize, shared_dir

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels of the upper tree that a task builds at once.
ARITY, LEVELS = 3, 6
#: Rows whose paths a worker holds at once.
ROWS = 4096
#: Bytes of the table of paths up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
PATH = "array<struct<left:string,right:string>>"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
#: Group number of a group that goes on beyond the partition it begins in, beside that partition's number.
GOES_ON = (1 << 31) - 1


def field(value: Column) -> Column:
    """``-`` if null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]).cast("binary"), 256))


def verified(start: Column, path: Column, root: Column) -> Column:
    return fold(start, path) == root


def joined(path: Column) -> Column:
    """A path's digests, left to right, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class Local:
    """What a partition can build of a group: of each level the nodes that it has whole, and the ragged ones whose parents it can't complete."""

    def __init__(self, leaves: list[str], at: int, size: int) -> None:
        #: Of each level: the nodes, the index of the first, and which of them have their parent here.
        self.levels: list[tuple[list[str], int, int, int]] = []
        #: (level, index, digest)
        self.ragged: list[tuple[int, int, str]] = []
        nodes, here = leaves, size
        while here > 1:
            stop = at + len(nodes)
            first = -(-at // ARITY)
            end = max(first, -(-here // ARITY) if stop == here else stop // ARITY)
            a, b = (ARITY * first - at, min(ARITY * end - at, len(nodes))) if end > first else (0, 0)
            self.ragged += [(len(self.levels), at + k, nodes[k]) for k in (*range(a), *range(b, len(nodes)))]
            self.levels.append((nodes, at, a, b))
            if a == b:
                return
            nodes, at, here = [digest(nodes[k : min(k + ARITY, b)]) for k in range(a, b, ARITY)], first, -(-here // ARITY)
        self.ragged.append((len(self.levels), at, nodes[0]))

    def path(self, index: int) -> tuple[int, int, list[tuple[str, str]]]:
        """Of a leaf: level and index of the highest node here, and the path to it."""
        out = []
        for level, (nodes, at, a, b) in enumerate(self.levels):
            k = index - at
            if not a <= k < b:
                return level, index, out
            s = k - (k - a) % ARITY
            out.append(("".join(nodes[s:k]), "".join(nodes[k + 1 : min(s + ARITY, b)])))
            index //= ARITY
        return len(self.levels), index, out


def height(size: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // ARITY), h + 1
    return h


def runs(column: pa.Array) -> list[int]:
    """Where runs of equal values begin, and the end; nulls are equal to each other."""
    a, b = column[1:], column[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(column)]


def parts_of_groups(batches: Iterator[pa.RecordBatch], ends: dict) -> Iterator[tuple[int, int, int, pa.Table]]:
    """(group's number, place of the first row in the group, size of the group, rows) of each group in this partition. ends: of each partition's first and last group, if others have rows of them too: number, place and size."""
    part = TaskContext.get().partitionId()
    head, tail = ends.get((part, True)), ends.get((part, False))

    def one(number: int, held: list[pa.RecordBatch], last: bool) -> tuple[int, int, int, pa.Table]:
        rows = pa.Table.from_batches(held)
        gid, at, size = head if head and not number else tail if tail and last else ((part << 31) | number, 0, rows.num_rows)
        return gid, at, size, rows

    number, held = 0, []
    for b in batches:
        if not b.num_rows:
            continue
        cut = runs(b.column("grp"))
        for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if held and (k or runs(pa.concat_arrays([held[-1].column("grp")[-1:], b.column("grp")[:1]]))[1] == 1):
                yield one(number, held, False)
                number, held = number + 1, []
            held.append(b.slice(s, e - s))
    if held:
        yield one(number, held, True)


def block(rows: pd.DataFrame, target: int) -> tuple[list[dict], dict]:
    """Builds the tree over a block's nodes up to level ``target``, or to the group's root: a path for each of them, and the node on top."""
    nodes = {(x.level, x.idx): x.digest for x in rows.itertuples()}
    top, size = min(target, int(rows["height"].iloc[0])), int(rows["size"].iloc[0])
    for level in range(int(rows["level"].min()), top):
        here = -(-size // ARITY**level)
        for up in {i // ARITY for lv, i in nodes if lv == level}:
            nodes[level + 1, up] = digest([nodes[level, i] for i in range(ARITY * up, min(ARITY * up + ARITY, here))])
    out = []
    for x in rows.itertuples():
        path, i = [], x.idx
        for level in range(x.level, top):
            s, here = i - i % ARITY, -(-size // ARITY**level)
            path.append({"left": "".join(nodes[level, k] for k in range(s, i)), "right": "".join(nodes[level, k] for k in range(i + 1, min(s + ARITY, here)))})
            i //= ARITY
        out.append({"level": x.level, "idx": x.idx, "up_level": top, "up_idx": i, "path": path})
    return out, {"level": top, "idx": i, "digest": nodes[top, i]}


def trees(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """leaves: (grp, leaf, *order, ...). Returns the leaves with the coordinate (gid, level, idx) of the highest node that their partition has, and the ``path`` to it; and, of each such coordinate, grp, ``upper``, the path from there, and ``top``, the group's root."""
    spark = leaves.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    keys = ["grp", *order, "leaf", "row"]
    ranged = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row").checkpoint()
    counts = ranged.groupBy(F.spark_partition_id().alias("part"), "grp").agg(F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    counts = counts.select(
        "part", "n", F.sum("n").over(group).alias("size"), F.min("part").over(group).alias("start"),
        F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"),
    )
    shared = counts.filter(F.col("size") > F.col("n")).collect()  # two rows a partition at most
    ends = spark.sparkContext.broadcast({(r.part, r.at > 0): ((r.start << 31) | GOES_ON, r.at, r.size) for r in shared})

    def local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {k: [] for k in ("gid", "size", "height", "level", "idx", "digest")}
        groups = []
        for gid, at, size, rows in parts_of_groups(batches, ends.value):
            for level, idx, node in Local(rows["leaf"].to_pylist(), at, size).ragged:
                for k, v in zip(out, (gid, size, height(size), level, idx, node), strict=True):
                    out[k].append(v)
                groups.append(rows["grp"].slice(0, 1).combine_chunks())
            if len(groups) >= 10_000:
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()} | {"grp": pa.concat_arrays(groups)}, node_schema)
                out, groups = {k: [] for k in out}, []
        if groups:
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()} | {"grp": pa.concat_arrays(groups)}, node_schema)

    kind = dict(ranged.dtypes)["grp"]
    node_kind = f"gid long, size long, height int, level int, idx long, digest string, grp {kind}"
    grp_field = pa.field("grp", _arrow_type(spark, kind))
    node_schema = pa.schema([("gid", pa.int64()), ("size", pa.int64()), ("height", pa.int32()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), grp_field])
    state = materialize(ranged.select("grp", "leaf").mapInArrow(local_nodes, node_kind), "nodes")
    highest = state.agg(F.max("height")).first()[0] or 0
    links = []
    for target in range(LEVELS, highest + LEVELS, LEVELS):
        open_ = F.col("level") < F.least(F.lit(target), F.col("height"))
        # a block is the part of the tree below a node of level target
        found = state.filter(open_).withColumn("block", F.expr(f"idx div cast(pow({ARITY}, {target} - level) as bigint)"))

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            members, top = block(rows, target)  # noqa: B023  sent to the executors before target changes
            gid = int(rows["gid"].iloc[0])
            new = {"gid": gid, "size": int(rows["size"].iloc[0]), "height": int(rows["height"].iloc[0]), "at": 0} | top
            return pd.DataFrame([m | {"gid": gid} for m in members] + [new], columns=["gid", "size", "height", "level", "idx", "digest", "up_level", "up_idx", "path"]).astype({c: "Int64" for c in ("gid", "size", "height", "level", "idx", "up_level", "up_idx")}).assign(path=lambda d: [p if isinstance(p, list) else None for p in d["path"]])

        built = found.groupBy("gid", "block").applyInPandas(build, f"gid long, size long, height int, level int, idx long, digest string, up_level int, up_idx long, path {PATH}")
        built = materialize(built, "blocks")
        links.append(built.filter("up_level IS NOT NULL").select("gid", "level", "idx", "up_level", "up_idx", "path"))
        names = state.filter("grp IS NOT NULL").groupBy("gid").agg(F.first("grp").alias("grp"))
        new = built.filter("up_level IS NULL").select("gid", "size", "height", "level", "idx", "digest").join(names, "gid", "left")
        state = materialize(state.filter(~open_).unionByName(new.select(*state.columns)), "nodes")
    above = state.select("gid", "level", "idx", "grp", F.array().cast(PATH).alias("upper"), F.col("digest").alias("top"))
    for rows in reversed(links):
        up = above.select("gid", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), "grp", "upper", "top")
        down = rows.join(up, ["gid", "up_level", "up_idx"]).select("gid", "level", "idx", "grp", F.concat("path", "upper").alias("upper"), "top")
        above = materialize(above.unionByName(down), "above")

    others = [f for f in ranged.schema.fields if f.name != "grp"]
    steps = pa.list_(STEP)

    def local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, at, size, rows in parts_of_groups(batches, ends.value):
            built = Local(rows["leaf"].to_pylist(), at, size)
            for s in range(0, rows.num_rows, ROWS):
                piece = rows.slice(s, ROWS).drop_columns(["grp"]).combine_chunks()
                got = [built.path(at + s + k) for k in range(piece.num_rows)]
                level, idx, path = zip(*got, strict=True)
                path = pa.array([[{"left": x, "right": y} for x, y in p] for p in path], steps)
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in piece.columns]
                columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([gid] * len(got), pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), path], names=[*piece.column_names, "gid", "level", "idx", "path"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return ranged.mapInArrow(local_paths, f"{kinds}, gid long, level int, idx long, path {PATH}"), above


def _arrow_type(spark: SparkSession, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.range(0).select(F.lit(None).cast(kind)).schema[0].dataType)


def with_proofs(located: DataFrame, above: DataFrame) -> DataFrame:
    """The leaves with their whole path and their group's root. The table of paths is broadcast if its bytes, summed up, are few."""
    size = above.agg(F.sum(F.lit(200) + F.coalesce(F.aggregate("upper", F.lit(0), lambda a, x: a + F.length(x["left"]) + F.length(x["right"]) + 32), F.lit(0)))).first()[0] or 0
    above = F.broadcast(above) if size <= BROADCAST_BYTES else above
    out = located.join(above, ["gid", "level", "idx"])
    return out.withColumn("path", F.concat("path", "upper")).drop("gid", "level", "idx", "upper")


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """A row a row of docs: doc_id, source, leaf, subroot, root, proof (the path from the leaf via its source's root to the root), and changed_leaf: the leaf with some fields replaced by ``changed``, null where that is the leaf itself."""
    now = leaf([F.col(c) for c in fields])
    other = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    leaves = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), now.alias("leaf"), (F.nullif(other, now) if changed else F.lit(None).cast("string")).alias("changed_leaf"))
    leaves = materialize(leaves, "leaves")
    located, above = trees(leaves, ["id"])
    roots = above.select(F.col("gid").alias("tree"), F.col("grp").alias("name"), F.col("top").alias("leaf")).distinct()
    roots = materialize(roots.withColumn("grp", F.lit(0)), "roots")
    top = with_proofs(*trees(roots, ["name"])).select(F.col("tree").alias("gid"), "path", F.col("top").alias("root"))
    top = materialize(top, "top")
    if top.count() <= ROWS:
        top = F.broadcast(top)
    above = materialize(above.join(top, "gid").withColumn("upper", F.concat("upper", "path")).drop("path"), "above")
    out = with_proofs(located, above)
    return out.select(F.col("id").alias("doc_id"), F.col("grp").alias("source"), "leaf", F.col("top").alias("subroot"), "root", F.col("path").alias("proof"), "changed_leaf")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = merkle_manifest(docs, changed={"text": tampered})
    m = m.withColumn("folded_root", fold(F.coalesce("changed_leaf", "leaf"), F.col("proof")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(joined(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, n_chars, lang, text, CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END AS f_id,
         CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS f_source, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS f_lang,
         CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END AS f_chars,
         xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k) & 1))),
             lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295::BIGINT), 4294967295) % 2 = 0 AS hit
  FROM documents),
e AS (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS tampered FROM d),
leaves AS (
  SELECT doc_id, source, sha256(f_id || f_source || f_lang || f_chars || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(f_id || f_source || f_lang || f_chars || CASE WHEN tampered IS NULL THEN '-' ELSE strlen(tampered) || ':' || tampered END) AS changed FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS lv, i, n, leaf AS x FROM placed
  UNION ALL
  SELECT source, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, lv, i // 3, n),
subroots AS (SELECT source, x AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lv, i, n, subroot AS x FROM subroots
  UNION ALL
  SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lv, i // 3, n),
steps AS (
  SELECT p.doc_id, p.source, p.i AS leaf_i, s.lv, string_agg(s.x, '' ORDER BY s.i) FILTER (WHERE s.i < p.i // pow(3, s.lv)::BIGINT) AS l, string_agg(s.x, '' ORDER BY s.i) FILTER (WHERE s.i > p.i // pow(3, s.lv)::BIGINT) AS r
  FROM placed p JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.n > 1 AND s.i // 3 = p.i // pow(3, s.lv + 1)::BIGINT GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.source, p.i, 100 + t.lv, string_agg(t.x, '' ORDER BY t.i) FILTER (WHERE t.i < u.i // pow(3, t.lv)::BIGINT), string_agg(t.x, '' ORDER BY t.i) FILTER (WHERE t.i > u.i // pow(3, t.lv)::BIGINT)
  FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source JOIN tops t ON t.n > 1 AND t.i // 3 = u.i // pow(3, t.lv + 1)::BIGINT GROUP BY ALL),
numbered AS (SELECT source, leaf_i, coalesce(l, '') AS l, coalesce(r, '') AS r, row_number() OVER (PARTITION BY source, leaf_i ORDER BY lv) AS k, lv FROM steps),
folds AS (
  SELECT source, i, 0::BIGINT AS k, changed AS x FROM placed
  UNION ALL
  SELECT f.source, f.i, f.k + 1, sha256(n.l || f.x || n.r) FROM folds f JOIN numbered n ON n.source IS NOT DISTINCT FROM f.source AND n.leaf_i = f.i AND n.k = f.k + 1),
proofs AS (SELECT source, leaf_i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, max(k) AS k FROM numbered GROUP BY source, leaf_i)
SELECT p.doc_id, p.leaf, u.subroot, (SELECT x FROM tops WHERE n = 1) AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = (SELECT x FROM tops WHERE n = 1) AS verified
FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source LEFT JOIN proofs q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_i = p.i
JOIN folds f ON f.source IS NOT DISTINCT FROM p.source AND f.i = p.i AND f.k = coalesce(q.k, 0)
"""
