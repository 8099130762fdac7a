"""Joins of the catalogue. Keys that the two sides must match uniquely are counted before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def unique_identity_join(tracks: DataFrame, rows: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of a source with ``status`` and, where exactly one row and one track share the identity, track_id.

    matched: one to one; ambiguous: some track has the identity, but not one to one; unmatched: none has.
    """
    by_track = tracks.groupBy(*identity).agg(F.count("*").alias("_tracks"), F.min("track_id").alias("_track"))
    by_row = rows.groupBy(*identity).agg(F.count("*").alias("_rows"))
    named = rows.join(by_row, identity).join(by_track, identity, "left")
    unique = (C("_tracks") == 1) & (C("_rows") == 1)
    status = F.when(unique, "matched").when(C("_tracks").isNotNull(), "ambiguous").otherwise("unmatched")
    return named.withColumn("status", status).withColumn("matched_track_id", F.when(unique, C("_track"))).drop("_tracks", "_rows", "_track")


def closed_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses to leave a left row without a match."""
    if not left.join(right.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"rows without a match on {key}")
    return left.join(right, key)


def frozen_ranks(judgments: DataFrame, results: DataFrame) -> DataFrame:
    """Judgments of triplets with the frozen ranks of candidates A and B (null where not in the ranking)."""
    ranks = results.select("configuration_id", "anchor_track_id", C("candidate_track_id").alias("_c"), "rank")
    out = judgments
    for side in "ab":
        out = out.join(ranks.withColumnsRenamed({"_c": f"candidate_{side}", "rank": f"rank_{side}"}), ["configuration_id", "anchor_track_id", f"candidate_{side}"], "left")
    return out


def counts_per(sets: DataFrame, key: str, **children: tuple[DataFrame, Column]) -> DataFrame:
    """sets with a count of each child's distinct values; children are counted before they join."""
    for name, (rows, what) in children.items():
        sets = sets.join(rows.groupBy(key).agg(F.count_distinct(what).alias(name)), key, "left").fillna({name: 0})
    return sets


def pool_candidates(anchors: DataFrame, corpus: DataFrame) -> DataFrame:
    """(anchor, candidate): the anchor's own pool if it has one, else the corpus, never the anchor itself."""
    own = anchors.where("size(pool) > 0").select("anchor_track_id", F.explode("pool").alias("candidate_track_id")).distinct()
    any_ = anchors.where("pool IS NULL OR size(pool) = 0").select("anchor_track_id", "set_id").join(corpus.select("set_id", C("track_id").alias("candidate_track_id")), "set_id").drop("set_id")
    return own.unionByName(any_).where("anchor_track_id <> candidate_track_id")


def neighbour_groups(results: DataFrame, configs: DataFrame, tracks: DataFrame, order: list[str]) -> DataFrame:
    """A row for each configuration in the requested order, with its ranked tracks."""
    joined = results.join(configs, "configuration_id").join(tracks, C("candidate_track_id") == C("track_id"))
    at = F.array_position(F.array(*map(F.lit, order)), C("configuration_id"))
    return joined.groupBy("anchor_track_id", "configuration_id").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id", "title"))).alias("ranked")).withColumn("position", at)


def reuse_evidence(targets: DataFrame, stages: DataFrame) -> DataFrame:
    """Targets with the latest succeeded other stage of the same cache key."""
    donors = stages.where("status = 'succeeded' AND cache_key IS NOT NULL").groupBy("cache_key", C("stage_id").alias("donor_id")).agg(F.max("finished_at").alias("donor_finished"))
    # the two latest donors of a key suffice: a target can be one of them only
    top = donors.withColumn("_place", F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("donor_finished"), "donor_id"))).where("_place <= 2")
    pairs = targets.join(top, "cache_key").where("stage_id <> donor_id")
    return first_per(pairs, ["stage_id", "cache_key"], ["_place"]).drop("_place")


def eligible_stages(stages: DataFrame, cancelled_runs: DataFrame, now, max_attempts: int) -> DataFrame:
    """Stages a worker could take: queued, or failed but retryable; not of cancelled runs; no running twin."""
    open_ = (C("status") == "queued") | ((C("status") == "failed") & C("retryable") & (C("attempt_count") < max_attempts))
    running = stages.where("status = 'running' AND cache_key IS NOT NULL").select("cache_key").distinct()
    return stages.where(open_).join(cancelled_runs.select("run_id"), "run_id", "left_anti").join(running, "cache_key", "left_anti")


def split_import(rows: DataFrame, existing: DataFrame, key: str, changed: Column) -> DataFrame:
    """rows with ``action``: insert, update or keep."""
    met = rows.alias("n").join(existing.alias("o"), key, "left")
    return met.withColumn("action", F.when(C("o._here").isNull(), "insert").when(changed, "update").otherwise("keep"))


def crate_rows(items: DataFrame, tracks: DataFrame) -> DataFrame:
    return items.join(tracks, "track_id").orderBy("crate_id", "position")


def cards(recommendations: DataFrame, candidates: DataFrame, limit: int = 8) -> DataFrame:
    """Known candidates in the order of recommendation, each once."""
    once = first_per(recommendations, ["request_id", "track_id"], ["position"])
    known = once.join(candidates, "track_id")
    return known.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("position"))).where(C("_n") <= limit).drop("_n")


def order_by_neighbours(tracks: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(source, track) by rank; hidden tracks left out."""
    return neighbours.join(tracks.where("NOT coalesce(hidden, false)"), "track_id")


def coordinates(tracks: DataFrame, *sources: DataFrame, fallback: Column) -> DataFrame:
    """x and y from the first source that has the track, else the fallback's."""
    out, points = tracks, []
    for n, source in enumerate(sources):
        out = out.join(source.select("track_id", F.struct("x", "y").alias(f"_p{n}")), "track_id", "left")
        points.append(C(f"_p{n}"))
    return out.withColumn("_p", F.coalesce(*points, fallback)).select(*tracks.columns, C("_p.x").alias("x"), C("_p.y").alias("y"))


def playback_object(objects: DataFrame) -> DataFrame:
    """The preview's key of a track, else the original's; blank keys are none."""
    key = F.nullif(F.trim("object_key"), F.lit(""))
    return objects.groupBy("track_id").agg(F.coalesce(F.min(F.when(C("kind") == "preview", key)), F.min(F.when(C("kind") == "original", key))).alias("object_key"))
