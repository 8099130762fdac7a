"""A corpus's exact neighbours, kept current without comparing everything again.

``NeighbourStore`` keeps, under a path: the statistics of standardization, frozen when it is built; the unit vectors; and
the list of each track's k nearest. ``update`` takes the corpus as it is now and finds what was added, changed or removed.
Vectors that are new (added or changed) meet all vectors in blocks, which gives their own lists and what they
bring into others: a list is merged with the k best new ones. A list that held a changed or removed track has lost a
member that can't be told from the list, so these tracks meet all vectors as well. All other pairs are left alone: pairs
computed are (new + lost) times the corpus.

Every update writes a version beside the old one and then its number; readers see the last number written. A
failure before that leaves what was there.

Defined results: vectors without a direction take no part; ties go to the smaller id; a track that comes back is added;
an empty corpus has no lists.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.operators import similarity
from tracklens.operators.aggregates import stats_row
from tracklens.operators.chunk_pairs import cosines, meet, pack
from tracklens.operators.ranking import top_k
from tracklens.sources.shared import staged

C = F.col
UNITS, LISTS = "track_id string, u array<double>", "source string, target string, rank int, score double"


def meet_all(asked: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(source, target, score) of asked (track_id, u, fresh) and all units (track_id, u).

    Of each asked vector its k best, and of each vector its k best fresh ones, by partition of the other side.
    """
    points = lambda d: d.select(C("track_id").alias("id"), C("u").alias("v"))
    rows, every = (pack(points(d), d.count(), similarity.BLOCK) for d in (asked, units))
    fresh = pack(points(asked.where("fresh")), rows.n, similarity.BLOCK)
    schema = "source string, target string, score double"
    own = meet(rows, every, cosines(k), schema)
    return own.union(meet(every, fresh, cosines(k), schema)) if fresh.count else own


class NeighbourStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, k: int = 25) -> NeighbourStore:
        """From (track_id, embedding)."""
        store = cls(vectors.sparkSession, path)
        stats_row(vectors).withColumn("k", F.lit(k)).coalesce(1).write.parquet(f"{store.path}/stats")
        units = staged(store._units(vectors), "units")
        ranked = top_k(similarity.block_pairs(units, k, max(1, math.ceil(units.count() / similarity.BLOCK))), ["source"], [F.desc("score"), "target"], k)
        store._publish(0, units, ranked)
        return store

    def version(self) -> int:
        return self.spark.read.schema("version int").parquet(f"{self.path}/versions").coalesce(1).agg(F.max("version")).first()[0]

    def units(self) -> DataFrame:
        return self.spark.read.schema(UNITS).parquet(f"{self.path}/units-{self.version()}")

    def lists(self) -> DataFrame:
        """(source, target, rank, score)."""
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/lists-{self.version()}")

    def nearest(self, track_id: str, limit: int = 25) -> DataFrame:
        """One track's list."""
        return self.lists().where((C("source") == track_id) & (C("rank") <= limit)).orderBy("rank")

    def rank(self, track_id: str, limit: int = 80) -> DataFrame:
        """(track_id, score) of the tracks nearest to one, more of them than its list has: a pass over the kept vectors."""
        return similarity.rank_units(self.units(), track_id, limit)

    def _stats(self) -> DataFrame:
        return self.spark.read.schema("means array<double>, sds array<double>, k int").parquet(f"{self.path}/stats")  # one row

    def _units(self, vectors: DataFrame) -> DataFrame:
        z = F.transform(F.arrays_zip("embedding", "means", "sds"), lambda t: F.when(t["sds"] > 0, (t["embedding"].cast("double") - t["means"]) / t["sds"]).otherwise(0.0))
        return vectors.select(C("track_id").cast("string").alias("track_id"), "embedding").crossJoin(F.broadcast(self._stats())).select("track_id", S.l2_normalize(z).alias("u")).where("u IS NOT NULL")

    def _publish(self, version: int, units: DataFrame, ranked: DataFrame) -> None:
        units.write.parquet(f"{self.path}/units-{version}")
        ranked.select("source", "target", C("rank").cast("int").alias("rank"), "score").write.parquet(f"{self.path}/lists-{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def update(self, vectors: DataFrame) -> dict[str, int]:
        """Makes the store that of vectors (track_id, embedding); says what was done and how many pairs were computed."""
        k, version, old, lists = self._stats().first().k, self.version(), self.units(), self.lists()
        units = staged(self._units(vectors), "units")
        if units.groupBy("track_id").count().where("count > 1").limit(1).count():
            raise ValueError("a track has several vectors")
        both = units.select("track_id", C("u").alias("new")).join(old.select("track_id", C("u").alias("old")), "track_id", "full")
        kind = F.when(C("old").isNull(), "added").when(C("new").isNull(), "removed").when(C("old") != C("new"), "changed")
        changes = staged(both.select("track_id", kind.alias("kind")).where("kind IS NOT NULL"), "changes")
        counts = {r.kind: r["count"] for r in changes.groupBy("kind").count().collect()}
        gone = changes.where("kind <> 'added'").select("track_id")
        lost = lists.join(gone.withColumnRenamed("track_id", "target"), "target", "left_semi").select(C("source").alias("track_id")).distinct()
        fresh = changes.where("kind <> 'removed'").select("track_id", F.lit(True).alias("fresh"))
        again = lost.join(changes.select("track_id"), "track_id", "left_anti").select("track_id", F.lit(False).alias("fresh"))
        asked = staged(units.join(fresh.union(again), "track_id"), "asked")
        n, total = asked.count(), units.count()
        report = {"added": 0, "changed": 0, "removed": 0, **counts, "recomputed": asked.where("NOT fresh").count(), "pairs": n * total}
        if not counts:
            return report
        met = staged(meet_all(asked, units, k), "met")
        own = asked.select(C("track_id").alias("source"), F.lit(True).alias("_own"))
        # lists of tracks that weren't asked are whole: what they hold is still there
        kept = lists.select("source", "target", "score").join(own, "source", "left_anti").join(gone.withColumnRenamed("track_id", "source"), "source", "left_anti")
        merged = met.union(kept).groupBy("source", "target").agg(F.max("score").alias("score"))
        self._publish(version + 1, units, top_k(merged, ["source"], [F.desc("score"), "target"], k))
        return report
