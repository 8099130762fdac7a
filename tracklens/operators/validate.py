"""Fail-closed checks: each gives the rows that break a rule, ``require_none`` refuses to go on with any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row doesn't meet; unknown counts as not met."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return rows.select(C(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def require_none(broken: DataFrame, what: str) -> None:
    first = broken.limit(3).collect()
    if first:
        raise ValueError(f"{what}: {', '.join(map(str, first))}")


def corpus_check(vectors: DataFrame) -> DataFrame:
    """One row of what k-NN needs to be true of a corpus (track_id, model, embedding)."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    each = vectors.groupBy("track_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.min("model").alias("m"), F.max("model").alias("m2"), F.count_if(~finite).alias("bad"), F.count_if(zero).alias("zero"))
    return each.agg(
        F.count("*").alias("tracks"),
        F.coalesce(F.max("n") == 1, F.lit(False)).alias("one_each"),
        F.coalesce(F.min("a") == F.max("b"), F.lit(False)).alias("one_dim"),
        F.coalesce(F.min("m") == F.max("m2"), F.lit(False)).alias("one_model"),
        F.coalesce(F.sum("bad") == 0, F.lit(False)).alias("finite"),
        F.coalesce(F.sum("zero") == 0, F.lit(False)).alias("not_zero"),
    )


def require_corpus(vectors: DataFrame) -> None:
    found = corpus_check(vectors).first()
    broken = [x for x in ("one_each", "one_dim", "one_model", "finite", "not_zero") if not found[x]]
    if found.tracks == 0 or broken:
        raise ValueError(f"corpus is not usable: {', '.join(broken) or 'empty'}")


def manifest_conflicts(manifests: DataFrame) -> DataFrame:
    """(name, version) that occur with several contents."""
    return manifests.groupBy("name", "version").agg(F.count_distinct("manifest_hash").alias("hashes")).where("hashes > 1")


def identity_mismatches(runs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Runs whose stored model or content differs from what is resolved now."""
    met = runs.join(resolved, "run_id")
    reason = F.when(C("model") != C("resolved_model"), "model").when(C("content_hash") != C("resolved_hash"), "source changed")
    return met.withColumn("reason", reason).where("reason IS NOT NULL").select("run_id", "reason")


def set_integrity(anchors: DataFrame, corpus: DataFrame) -> DataFrame:
    """(set_id, kind, track_id): anchors and members of pools that are outside their set's corpus."""
    named = anchors.select("set_id", F.lit("anchor").alias("kind"), C("anchor_track_id").alias("track_id"))
    pools = anchors.select("set_id", F.lit("pool").alias("kind"), F.explode("pool").alias("track_id"))
    return named.union(pools).distinct().join(corpus, ["set_id", "track_id"], "left_anti").select("set_id", "kind", "track_id")
