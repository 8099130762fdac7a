"""Evaluation of retrieval configurations against judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def blind(rows: DataFrame, hidden: Column, columns: list[str]) -> DataFrame:
    """Columns that a blind evaluation hides are null where ``hidden``."""
    return rows.withColumns({c: F.when(~hidden, C(c)) for c in columns})


def accepted_at_k(judgments: DataFrame) -> DataFrame:
    """Share of similar among judgments that weren't skipped, for each configuration and dimension."""
    said = judgments.where("judgment <> 'skip'")
    return said.groupBy("configuration_id", "dimension").agg(F.avg(F.when(C("judgment") == "similar", 1.0).otherwise(0.0)).alias("value"), F.count("*").alias("sample_count"))


def ndcg(judgments: DataFrame, k: int = 10) -> DataFrame:
    """nDCG over the k graded judgments of least rank (all anchors pooled); 0 if no grade is above 0."""
    keys = ["configuration_id", "dimension"]
    graded = judgments.where("ordinal_rating IS NOT NULL AND rank_position IS NOT NULL")
    first = graded.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank_position", "judgment_id"))).where(C("_n") <= k)
    ideal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ordinal_rating")))
    gain = F.pow(F.lit(2.0), C("ordinal_rating")) - 1
    sums = first.withColumn("_i", ideal).groupBy(*keys).agg(F.sum(gain / F.log2(C("rank_position") + 1)).alias("dcg"), F.sum(gain / F.log2(C("_i") + 1)).alias("idcg"), F.count("*").alias("sample_count"))
    return sums.select(*keys, F.when(C("idcg") > 0, C("dcg") / C("idcg")).otherwise(0.0).alias("value"), "sample_count")


def triplet_accuracy(ranked: DataFrame) -> DataFrame:
    """Share of decided triplets whose closer candidate ranks first; both ranks must be known."""
    known = ranked.where("rank_a IS NOT NULL AND rank_b IS NOT NULL AND decision IN ('a_closer', 'b_closer')")
    right = F.when(C("decision") == "a_closer", C("rank_a") < C("rank_b")).otherwise(C("rank_b") < C("rank_a"))
    return known.groupBy("configuration_id", "dimension").agg(F.avg(right.cast("double")).alias("value"), F.count("*").alias("sample_count"))


def with_silent(metrics: DataFrame, configurations: DataFrame) -> DataFrame:
    """Configurations without a row get one: dimension overall, no value, no samples."""
    met = configurations.join(metrics, "configuration_id", "left")
    return met.withColumn("dimension", F.coalesce("dimension", F.lit("overall"))).fillna({"sample_count": 0})


def own_metrics(metrics: DataFrame, run_configurations: DataFrame) -> DataFrame:
    """Operational metrics of the run's configurations, the latest of each name."""
    own = metrics.join(run_configurations, "configuration_id", "left_semi")
    w = Window.partitionBy("configuration_id", "metric_name").orderBy(F.desc("seq"))
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def configuration_report(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row for each configuration: its overall metrics as columns, and the largest sample."""
    wide = metrics.where("dimension = 'overall'").groupBy("configuration_id").pivot("metric_name", names).agg(F.first("value"))
    return wide.join(metrics.groupBy("configuration_id").agg(F.max("sample_count").alias("judgment_count")), "configuration_id")


def incomplete_rankings(results: DataFrame, pools: DataFrame, k: int) -> DataFrame:
    """Frozen rankings that aren't 1..min(k, pool) of their pool, with the reason."""
    keys = ["configuration_id", "anchor_track_id"]
    have = results.groupBy(*keys).agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("rank").alias("ranks"))
    size = pools.groupBy("anchor_track_id").agg(F.count_distinct("candidate_track_id").alias("pool"))
    foreign = results.join(pools, ["anchor_track_id", "candidate_track_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("foreign"))
    met = have.join(size, "anchor_track_id").join(foreign, keys, "left").fillna({"foreign": 0})
    reason = F.when(C("foreign") > 0, "outside pool").when(C("n") != F.least(F.lit(k), C("pool")), "wrong count").when((C("top") != C("n")) | (C("ranks") != C("n")), "ranks not contiguous")
    return met.withColumn("reason", reason).where("reason IS NOT NULL").select(*keys, "reason")


def judgment_conflicts(judgments: DataFrame, results: DataFrame, members: DataFrame) -> DataFrame:
    """(judgment_id, reason, rank_position): why a judgment doesn't fit its frozen ranking; ranks are filled in.

    One idempotency key with several contents is a conflict too.
    """
    frozen = results.select("configuration_id", "anchor_track_id", "candidate_track_id", C("rank").alias("frozen"))
    met = judgments.join(frozen, ["configuration_id", "anchor_track_id", "candidate_track_id"], "left").join(members.withColumn("_member", F.lit(True)), "evaluator_id", "left")
    signature = F.xxhash64("configuration_id", "anchor_track_id", "candidate_track_id", "judgment", "evaluator_id")
    keys = met.groupBy("idempotency_key").agg((F.min(signature) != F.max(signature)).alias("_clash"))
    met = met.join(keys, "idempotency_key")
    reason = F.when(C("_member").isNull(), "not a member").when(C("frozen").isNull(), "not in ranking").when(C("rank_position") != C("frozen"), "rank differs").when(C("_clash"), "key reused")
    return met.select("judgment_id", reason.alias("reason"), F.coalesce("rank_position", "frozen").alias("rank_position"))


def promotions(metrics: DataFrame, baseline: str) -> DataFrame:
    """(configuration_id, promoted): 10 % more nDCG or 5 points more triplet accuracy overall than the baseline, and
    no dimension more than 10 points below it."""
    base = metrics.where(C("configuration_id") == baseline).select("metric_name", "dimension", C("value").alias("base"))
    met = metrics.where(C("configuration_id") != baseline).join(base, ["metric_name", "dimension"])
    overall = C("dimension") == "overall"
    better = overall & (((C("metric_name") == "ndcg_at_10") & (C("value") >= 1.1 * C("base"))) | ((C("metric_name") == "triplet_accuracy") & (C("value") >= C("base") + 0.05)))
    worse = C("value") < C("base") - 0.1
    return met.groupBy("configuration_id").agg((F.coalesce(F.bool_or(better), F.lit(False)) & ~F.coalesce(F.bool_or(worse), F.lit(False))).alias("promoted"))
