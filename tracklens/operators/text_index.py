"""Search for words in titles and artists without reading all of them.

``TextIndex.build`` keeps, under a path, a posting (gram, track_id) for each run of three characters of a track's text
("title artist" in lower case), how many postings each gram has, and the tracks' texts. Postings and counts lie
in BUCKETS folders by a hash of the gram and are ordered by it there, so a search reads the folders of its grams, and
of their files only what may hold them; a gram that very many tracks have is spread over several files.

A search intersects the postings of the FEW rarest of its grams, reads the texts of what is left, keeps those that
hold the whole search text, and takes a page by a bounded top-k. Texts of fewer than three characters have no gram:
for these all texts are scanned.

Defined results: null titles and artists are empty; an empty search finds every track; newest first, then by id; a page
beyond the end is empty; tracks without an id aren't kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.sources.shared import staged

C = F.col
BUCKETS, FEW = 32, 4


def searched(tracks: DataFrame) -> DataFrame:
    """(track_id, created_at, text)."""
    part = lambda c: F.coalesce(C(c).cast("string"), F.lit(""))
    return tracks.where("track_id IS NOT NULL").select("track_id", "created_at", F.lower(F.concat(part("title"), F.lit(" "), part("artist"))).alias("text"))


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def page(found: DataFrame, offset: int, limit: int) -> DataFrame:
    return found.orderBy(F.desc("created_at"), "track_id").offset(offset).limit(limit)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, tracks: DataFrame, path: str) -> TextIndex:
        index = cls(tracks.sparkSession, path)
        index._write(tracks)
        return index

    def append(self, tracks: DataFrame) -> None:
        """Adds tracks that aren't in the index yet."""
        if not tracks.select("track_id").join(self._texts().select("track_id"), "track_id", "left_semi").isEmpty():
            raise ValueError("a track can be in the index once only")
        self._write(tracks)

    def _write(self, tracks: DataFrame) -> None:
        texts = staged(searched(tracks), "texts")
        each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring(C("text"), i, F.lit(3))))
        postings = texts.where(F.length("text") > 2).select(F.explode(each).alias("gram"), "track_id").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        postings.repartitionByRange("bucket", "gram", "track_id").sortWithinPartitions("bucket", "gram", "track_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = postings.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/counts")
        texts.write.mode("append").parquet(f"{self.path}/texts")

    def _texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        """The rows of the grams; only their folders are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).collect()]
        return self.spark.read.parquet(f"{self.path}/{table}").where(C("bucket").isin(sorted(set(buckets))) & C("gram").isin(grams))

    def candidates(self, said: str) -> DataFrame | None:
        """(track_id) of tracks that have the rarest grams of a text; None where it has no gram."""
        grams = grams_of(said)
        if not grams:
            return None
        n = {r.gram: r.n for r in self._of("counts", grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the text's grams
        rare = sorted(grams, key=lambda g: (n.get(g, 0), g))[:FEW]
        if len(n) < len(grams):
            rare = [g for g in grams if g not in n][:1]  # no track has it
        met = self._of("postings", rare)
        return met.groupBy("track_id").agg(F.count("*").alias("n")).where(C("n") == len(rare)).select("track_id")

    def search(self, said: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """(track_id, created_at): a page of the tracks whose text holds the words, newest first."""
        low = said.strip().lower()
        texts, some = self._texts(), self.candidates(low)
        found = texts if some is None else texts.join(some, "track_id", "left_semi")
        return page(found.where(F.contains("text", F.lit(low))), offset, limit).select("track_id", "created_at")
