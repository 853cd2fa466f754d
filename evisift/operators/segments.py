"""An inverted index that is kept up to date: segments, tombstones, deltas of statistics, compaction.

Below the index' folder each change has a segment: ``bags`` of the units that it adds
(as bm25.whole_bags makes them, a row a unit: what is joined and copied are units, not
postings), ``gone``, the keys that it takes away, and ``deltas``:
by token, how many units more or fewer have it, and under bm25.MARK how many units and
tokens there are more or fewer. A changed unit is in both, its old bag being gone and
its new one in the same segment. What is live are the bags of a segment whose key no
later one has in ``gone``. Statistics are sums of deltas: no bag is read for them.

A version is a file that lists its segments. It is written last, under a name that must
not be there yet, so that a change that breaks off, or a second one at the same time,
leaves the index as it was. Compaction writes what is live as one segment; folders that
no version lists any longer are removed by vacuum(), when no reader has them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.operators.bm25 import MARK, index, posted, small, whole_bags
from evisift.storage import exists, file_system, materialize, remove

#: Names of the version files have so many digits.
DIGITS = 12


@dataclass(frozen=True)
class Statistics:
    """Of the live units: how many, their mean length (1 if that is 0), and (token, df)."""

    n_units: int
    avgdl: float
    df: DataFrame


class MaintainedIndex:
    """path: a folder on any file system that Spark knows. keep: columns of units that postings carry."""

    def __init__(self, spark: SparkSession, path: str, key: str = "pos", text: Column | str = "text", keep: Sequence[str] = ()) -> None:
        self.spark, self.path, self.key, self.text, self.keep = spark, path.rstrip("/"), key, text, tuple(keep)

    # Versions ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/versions"):
            return []
        fs, where = file_system(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def segments(self, version: int | None = None) -> list[str]:
        """Folders of a version, by default the last, in the order of their changes."""
        found = self.versions()
        if not found:
            return []
        (line,) = self.spark.read.text(f"{self.path}/versions/{(found[-1] if version is None else version):0{DIGITS}d}").collect()
        return json.loads(line.value)

    def commit(self, based_on: list[int], segments: list[str]) -> int:
        """A version more; an error if another change has made it meanwhile."""
        new = (based_on[-1] if based_on else -1) + 1
        fs, where = file_system(self.spark, f"{self.path}/versions/{new:0{DIGITS}d}")
        out = fs.create(where, False)  # fails if it is there
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        return new

    # Changes -------------------------------------------------------------------------------

    def change(self, put: DataFrame | None = None, delete: DataFrame | None = None) -> int:
        """put: units to add, or to change if their keys are there; they have ``text``'s columns and ``keep``. delete: keys. A key that is in both is put. Returns the new version."""
        before, live = self.versions(), self.segments()
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        keys = [df.select(self.key) for df in (put, delete) if df is not None]
        gone = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
        gone.distinct().write.parquet(f"{folder}/gone")
        gone = self.spark.read.parquet(f"{folder}/gone")
        deltas = []
        if live:
            old = self.bags(live).join(small(gone), self.key, "left_semi")
            deltas.append(self.counted(old, -1))
        if put is not None:
            whole_bags(put, self.key, self.text, self.keep).write.option("compression", "zstd").parquet(f"{folder}/bags")
            deltas.append(self.counted(self.spark.read.parquet(f"{folder}/bags"), 1))
        elif not deltas:
            return before[-1] if before else -1
        every = deltas[0] if len(deltas) == 1 else deltas[0].unionByName(deltas[1])
        self.summed(every).filter("n_units <> 0 OR dl <> 0").write.parquet(f"{folder}/deltas")
        return self.commit(before, [*live, folder])

    def sync(self, units: DataFrame) -> int:
        """Brings the index to hold exactly these units; only those whose length, tokens or ``keep`` differ are put. The last version if none does."""
        told = F.xxhash64("token", "tf", "dl", *self.keep).cast("decimal(38,0)")
        now = index(units, self.key, self.text, self.keep).groupBy(self.key).agg(F.sum(told).alias("now"))
        was = self.postings().groupBy(self.key).agg(F.sum(told).alias("was")) if self.segments() else now.select(self.key, F.col("now").alias("was")).limit(0)
        both = materialize(now.join(was, self.key, "full_outer").filter("NOT (now <=> was)"), "differ")
        put = units.join(small(both.filter("now IS NOT NULL").select(self.key)), self.key, "left_semi")
        if both.isEmpty():
            return self.versions()[-1] if self.versions() else self.change(put)
        return self.change(put, both.filter("now IS NULL").select(self.key))

    def compact(self) -> int:
        """All that is live in one segment."""
        before, live = self.versions(), self.segments()
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        self.bags(live).write.option("compression", "zstd").parquet(f"{folder}/bags")
        self.deltas(live).filter("n_units <> 0 OR dl <> 0").write.parquet(f"{folder}/deltas")
        self.spark.read.parquet(f"{folder}/bags").select(self.key).limit(0).write.parquet(f"{folder}/gone")
        return self.commit(before, [folder])

    def vacuum(self) -> list[str]:
        """Removes all versions but the last, and segments that it doesn't list."""
        keep, old = set(self.segments()), self.versions()[:-1]
        for v in old:
            remove(self.spark, f"{self.path}/versions/{v:0{DIGITS}d}")
        fs, where = file_system(self.spark, f"{self.path}/segments")
        names = {s.getPath().getName() for s in fs.listStatus(where)} - {k.rpartition("/")[2] for k in keep}
        for n in names:
            remove(self.spark, f"{self.path}/segments/{n}")
        return sorted(names)

    # Reading -------------------------------------------------------------------------------

    def parts(self, segments: list[str], what: str) -> list[tuple[int, DataFrame]]:
        return [(k, self.spark.read.parquet(f"{s}/{what}")) for k, s in enumerate(segments) if exists(self.spark, f"{s}/{what}")]

    def postings(self, segments: list[str] | None = None) -> DataFrame:
        """The live postings, for bm25's scores."""
        return posted(self.bags(segments), self.key, self.keep)

    def bags(self, segments: list[str] | None = None) -> DataFrame:
        """The live units' bags, for best_scores."""
        segments = self.segments() if segments is None else segments
        found = self.parts(segments, "bags")
        if not found:
            raise FileNotFoundError(f"no bags in {self.path}")
        every = self.joined([df.withColumn("segment", F.lit(k)) for k, df in found])
        gone = self.joined([df.withColumn("by", F.lit(k)) for k, df in self.parts(segments, "gone")])
        gone = materialize(gone.groupBy(self.key).agg(F.max("by").alias("by")).filter("by > 0"), "gone")  # the first takes nothing away
        late = small(gone.withColumnRenamed(self.key, "gone_key"))
        return every.join(late, (F.col(self.key) == F.col("gone_key")) & (F.col("by") > F.col("segment")), "left_anti").drop("segment")

    def deltas(self, segments: list[str]) -> DataFrame:
        return self.summed(self.joined([df for _, df in self.parts(segments, "deltas")]))

    def statistics(self) -> Statistics:
        every = self.deltas(self.segments())
        n, dl = every.filter(F.col("token") == MARK).agg(F.coalesce(F.sum("n_units"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return Statistics(n, dl / n if n and dl else 1.0, every.filter((F.col("token") != MARK) & (F.col("n_units") > 0)).select("token", F.col("n_units").alias("df")))

    def counted(self, bags: DataFrame, sign: int) -> DataFrame:
        """By token how many units have it; all units, and their lengths, under MARK."""
        rows = bags.select(F.explode(F.concat(F.array(F.lit(MARK)), "tokens")).alias("token"), "dl")
        return rows.groupBy("token").agg((F.count("*") * sign).alias("n_units"), (F.sum(F.when(F.col("token") == MARK, F.col("dl")).otherwise(0)) * sign).alias("dl"))

    @staticmethod
    def summed(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy("token").agg(F.sum("n_units").alias("n_units"), F.sum("dl").alias("dl"))

    @staticmethod
    def joined(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
