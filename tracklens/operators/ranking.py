"""Latest rows, ranks and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S

C = F.col


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Digits by which distinct values are cut into runs that are summed apart.
RUNS = 1000


def strict_percentile(df: DataFrame, column: str, keys: list[str] | None = None, name: str = "pct") -> DataFrame:
    """Share of the key's values below the row's; 0.5 where the row has none.

    Distinct values are counted first. Their counts are summed within runs of neighbouring values, cut at
    RUNS quantiles of the counted values, and the few sums of runs are added; so no task holds a key's values.
    """
    keys = keys or []
    value = F.when(~F.isnan(C(column).cast("double")), C(column))
    counts = df.where(value.isNotNull()).groupBy(*keys, C(column).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = counts.agg(F.array_distinct(F.array_sort(F.percentile_approx(C("_v").cast("double"), [i / RUNS for i in range(1, RUNS)], 10 * RUNS))).alias("_c"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(F.lit(0).alias("a"), F.size("_c").alias("b")), lambda s, _: _halved(s))  # 2**10 runs
    runs = counts.crossJoin(F.broadcast(cuts)).withColumn("_r", F.coalesce(place["a"], F.lit(0))).drop("_c")
    order = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy(*keys, "_r").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_a", F.sum("_s").over(Window.partitionBy(*keys))).drop("_s")
    pct = runs.withColumn("_p", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(F.broadcast(starts) if not keys else starts, [*keys, "_r"]).select(*keys, "_v", ((C("_p") + C("_b")) / C("_a")).alias("_p"))
    met = df.withColumn("_v", value).join(pct, [*keys, "_v"], "left")
    return met.withColumn(name, F.coalesce("_p", F.lit(0.5))).drop("_v", "_p")


def _halved(s):
    """A step of a binary search for the number of cuts that aren't above a value."""
    middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
    above = F.element_at("_c", middle + 1) > C("_v")
    done = s["a"] >= s["b"]
    return F.struct(F.when(done | above, s["a"]).otherwise(middle + 1).alias("a"), F.when(~done & above, middle).otherwise(s["b"]).alias("b"))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key, ranked from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(C(name) <= k)


def next_anchor(anchors: DataFrame, judgments: DataFrame, evaluators: DataFrame) -> DataFrame:
    """For each evaluator the anchor with the fewest of their judgments; then the oldest.

    Anchors, those of an evaluation, are numbered by age. The first number that an evaluator lacks is an anchor
    without judgments; only who lacks none needs counts. So evaluators and anchors aren't multiplied.
    """
    numbered = anchors.withColumn("_i", F.row_number().over(Window.orderBy("created_at", "anchor_track_id")) - 1)
    done = judgments.groupBy("evaluator_id", "anchor_track_id").agg(F.count("*").alias("judged")).join(numbered.select("anchor_track_id", "_i"), "anchor_track_id")
    own = done.groupBy("evaluator_id").agg(F.array_sort(F.collect_list("_i")).alias("_all"), F.min(F.struct("judged", "_i")).alias("_least"))
    first_gap = F.coalesce(F.size(F.filter("_all", lambda x, i: x == i)), F.lit(0))
    asked = evaluators.join(own, "evaluator_id", "left").crossJoin(anchors.agg(F.count("*").alias("_n")))
    fresh = first_gap < C("_n")
    chosen = asked.select(*evaluators.columns, F.when(fresh, first_gap).otherwise(C("_least._i")).alias("_i"), F.when(fresh, F.lit(0)).otherwise(C("_least.judged")).cast("long").alias("judged"))
    return chosen.join(numbered, "_i").drop("_i")


def top_labels(scores: DataFrame, k: int = 6) -> DataFrame:
    """Of (track_id, labels, scores) the k best as a map, the three best as text, and the best."""
    pairs = F.transform(F.arrays_zip("labels", "scores"), lambda t: F.struct((-t["scores"]).alias("s"), t["labels"].alias("label")))
    best = F.slice(F.array_sort(pairs), 1, k)
    out = scores.withColumn("_b", best)
    return out.select("track_id", F.map_from_entries(F.transform("_b", lambda t: F.struct(t["label"], S.exact_round(-t["s"], 4)))).alias("top"), F.concat_ws(", ", F.transform(F.slice("_b", 1, 3), lambda t: t["label"])).alias("text"), C("_b")[0]["label"].alias("label"), S.exact_round(-C("_b")[0]["s"], 4).alias("confidence"))


def metric_winners(metrics: DataFrame) -> DataFrame:
    """Winner and its lead for each (metric, dimension, k); the higher value wins whatever the metric."""
    w = Window.partitionBy("metric_name", "dimension", "k").orderBy(F.desc("value"), "configuration_id")
    return metrics.where("value IS NOT NULL").withColumn("_n", F.row_number().over(w)).withColumn("delta", C("value") - F.lead("value").over(w)).where("_n = 1").drop("_n")
