"""Sharding by balanced label propagation, under the law ``rows``: counts of shards are at most one apart.

Documents with equal texts are linked. Linked documents start in even shares; in each round a document
moves to the shard with room that most of its group is in, if that is more than where it is. Each shard
has a quota, its final number of rows; during the rounds it may hold SLACK more, and a round lets no more
in than that leaves. Rounds are joins of three narrow tables: documents, counts of (group, shard), and each
group's best shard; they end when nobody moves or no more links come to lie within shards. Then shards over their quota give up what is over it, from
their largest groups first, as those are cut in any case. What was given up, group by group, and then the
documents without links, which have no edges to cut, fill every shard up to its quota.

A group larger than a quota fills one shard after another, so it is cut into few parts.
Counts combine before they shuffle, and documents meet them by (group, shard), so a group that holds a third
of all rows is spread like any other rows.

Defined results: a null text counts as empty; null and repeated doc_ids are rows like others; slots are
gapless from 0 in each shard; texts are read whole, however long; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import keyed, number_within, partitions, stage, table

SHARDS = 24
SLACK = 0.25
#: Groups of at least 2**WIDE members are spread by member when they are numbered.
WIDE = 8
GROUP = ["g1", "g2"]


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def propagate(linked: DataFrame, quotas: list[int], least_gain: float) -> DataFrame:
    """linked: staged (k, g1, g2, shard), no shard over its quota. The same with the shards after the rounds.

    Rounds go on as long as documents move and the links within shards grow by more than ``least_gain`` of them.
    """
    within = -1.0
    while True:
        taken = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}  # a row for each shard
        room = [q - taken.get(j, 0) for j, q in enumerate(quotas)]
        rooms = F.array(*map(F.lit, room))
        votes = stage(linked.groupBy(*GROUP, "shard").agg(F.count("*").alias("n")), "votes")
        now = votes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        if now <= within * (1 + least_gain):
            break
        within = now
        open_ = votes.where(F.element_at(rooms, F.col("shard") + 1) > 0)
        best = open_.groupBy(*GROUP).agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("b")).select(*GROUP, F.col("b.n").alias("best_n"), (-F.col("b.minus")).alias("best"))  # a row a shard at most
        full = F.element_at(rooms, F.col("shard") + 1) <= 0  # of equal shards the first with room takes the group
        better = (F.col("best_n") > F.col("n")) | ((F.col("best_n") == F.col("n")) & ((F.col("best") < F.col("shard")) | full))
        wishes = stage(votes.join(best, GROUP).where(better).select(*GROUP, "shard", "best"), "wishes")
        movers = stage(linked.join(wishes, [*GROUP, "shard"]), "movers")
        if movers.isEmpty():
            break
        numbered = number_within(movers, ["best"], ["g1", "k"], "number").where(F.col("number") < F.element_at(rooms, F.col("best") + 1))
        moved = linked.join(numbered.select("k", "best"), "k", "left")
        linked = stage(moved.select("k", *GROUP, F.coalesce("best", "shard").alias("shard")), "linked")
    return linked


def give_up(linked: DataFrame, quotas: list[int], buckets: int) -> DataFrame:
    """(k, g1) of the rows by which shards exceed their quotas, largest groups first.

    Groups are classed by the power of two of their size: a shard and class are the bounded keys by which
    rows are counted and numbered.
    """
    size = stage(linked.groupBy(*GROUP).agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class")), "classes")
    classed = stage(linked.join(size, GROUP), "classed")
    counts = {(r["shard"], r["class"]): r["count"] for r in classed.groupBy("shard", "class").count().collect()}
    over: list[tuple[int, int, int]] = []
    for j, quota in enumerate(quotas):
        left = sum(n for (shard, _), n in counts.items() if shard == j) - quota
        for (shard, c), n in sorted(counts.items(), key=lambda x: -x[0][1]):
            if shard == j and left > 0:
                over.append((j, c, min(n, left)))
                left -= n
    number = F.lit(0)
    for j, c, n in over:  # a few classes of a few shards
        number = F.when((F.col("shard") == j) & (F.col("class") == c), n).otherwise(number)
    spread = F.when(F.col("class") < WIDE, F.col("g1")).otherwise(F.xxhash64("k"))
    numbered = number_within(classed, ["shard", "class"], ["g1", "k"], "number", buckets, spread)
    return stage(numbered.where(F.col("number") < number).select("k", "g1", "class"), "given-up")


def assign(docs: DataFrame, shards: int = SHARDS, least_gain: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    base = stage(
        keyed(docs).select("k", "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2")),
        "sizes",
    )
    n = base.count()
    quotas = _quotas(n, shards)
    # staged, here and below, so that plain tables meet in joins: AQE can split a group with very many rows
    several = stage(base.groupBy(*GROUP).count().where("count > 1").select(*GROUP), "several")
    buckets = 4 * partitions(docs.sparkSession)
    linked = stage(base.select("k", *GROUP).join(several, GROUP, "left_semi"), "groups")
    dealt = number_within(linked, [], ["k"], "number", buckets)
    linked = stage(dealt.select("k", *GROUP, F.pmod("number", F.lit(shards)).cast("int").alias("shard")), "linked")
    linked = propagate(linked, [int(q * (1 + SLACK)) + 1 for q in quotas], least_gain)
    given = give_up(linked, quotas, buckets)
    linked = stage(linked.select("k", "shard").join(given.select("k"), "k", "left_anti"), "settled")

    taken = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
    single = stage(base.select("k").join(linked.select("k"), "k", "left_anti").join(given, "k", "left").withColumn("one", F.col("g1").isNull().cast("int")), "single")
    spread = F.when(F.col("class") < WIDE, F.col("g1")).otherwise(F.xxhash64("k"))
    n_given = given.count()
    parts = [number_within(single.where(F.col("one") == one), [], ["g1", "k"], "number", buckets, spread).withColumn("number", F.col("number") + one * n_given) for one in (0, 1)]
    numbered = parts[0].union(parts[1])
    shard, until = F.lit(None).cast("int"), sum(q - taken.get(j, 0) for j, q in enumerate(quotas))
    for j in reversed(range(shards)):
        shard = F.when(F.col("number") < until, j).otherwise(shard)
        until -= quotas[j] - taken.get(j, 0)
    everywhere = linked.select("k", "shard").union(numbered.select("k", shard.alias("shard")))
    placed = stage(base.select("k", "doc_id", "size", "text_crc32").join(everywhere, "k"), "placed")
    slots = number_within(placed, ["shard"], ["k"], "slot", buckets)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL: dict[str, str] = {}
