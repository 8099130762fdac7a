"""Candidates and recommendations for prompts. Requests are tables, so many prompts are answered at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.operators.filters import rankable

C = F.col


def bpm_points(bpm: Column, centre: Column) -> Column:
    away = F.abs(bpm - centre)
    return F.coalesce(F.when(away <= 4, 8).when(away <= 8, 4).when(away <= 12, 1), F.lit(0))


def pick_candidates(tracks: DataFrame, prompt: str, visible: DataFrame, selected: DataFrame, seed_id: str | None, scores: DataFrame | None = None, limit: int = 48) -> DataFrame:
    """(track_id, points): the tracks a prompt is answered from; the seed only if nothing else is left."""
    t = rankable(tracks)
    t = t.join(visible.select("track_id", F.lit(3).alias("_v")), "track_id", "left").join(selected.select("track_id", F.lit(2).alias("_s")), "track_id", "left")
    t = t.join(scores.select("track_id", C("score").alias("_x")), "track_id", "left") if scores is not None else t.withColumn("_x", F.lit(None).cast("double"))
    seed = C("track_id") == seed_id if seed_id else F.lit(False)
    zero = F.lit(0)
    points = F.coalesce("_v", zero) + F.coalesce("_s", zero) + F.when(seed, 1).otherwise(0) + bpm_points(C("bpm"), S.prompt_bpm(F.lit(prompt))) + 4 * F.coalesce("_x", F.lit(0.0))
    ranked = t.select("track_id", "title", points.alias("points"), seed.alias("_seed"))
    others = ranked.agg(F.count_if(~C("_seed")).alias("_others"))
    return ranked.crossJoin(F.broadcast(others)).where(~C("_seed") | (C("_others") == 0)).orderBy(F.desc("points"), F.lower("title"), "title", "track_id").limit(max(1, limit)).select("track_id", "points")


def keyword_score(prompt: Column) -> Column:
    """A candidate's score under a prompt: words of its own, mood and energy the prompt asks for, tempo."""
    low = F.lower(prompt)
    named = F.filter(F.concat(F.array("mood", "energy", "genre"), "textures"), lambda w: F.contains(low, F.lower(w)))
    centre = F.coalesce(S.prompt_bpm(prompt), F.nullif(F.regexp_extract(low, r"\b(1[0-4]\d)\b", 1), F.lit("")).cast("int"))
    away = F.abs(C("bpm") - centre)
    bonus = lambda ok, points: F.when(ok, points).otherwise(0.0)
    return (
        C("score")
        + F.size(named) * 0.08
        + bonus(low.rlike("dark|darker|afterhours|late|warehouse") & (C("mood") == "dark"), 0.12)
        + bonus(low.rlike("warm|sunset|warm[ -]?up|opening|lounge") & (C("mood") == "warm"), 0.12)
        + bonus(low.rlike("low|lower|down|gentle") & (C("energy") == "low"), 0.1)
        + bonus(low.rlike("lift|peak|up|driving") & C("energy").isin("peak", "driving"), 0.1)
        + F.coalesce(F.when(away <= 4, 0.16).when(away <= 8, 0.08), F.lit(0.0))
    )


def recommend(candidates: DataFrame, limit: int = 6) -> DataFrame:
    """(request_id, position, track_id, reason, blend) for candidates with their request's prompt."""
    w = Window.partitionBy("request_id").orderBy(F.desc("_k"), "track_id")
    top = candidates.withColumn("_k", F.round(keyword_score(C("prompt")), 9)).withColumn("position", F.row_number().over(w)).where(C("position") <= limit)
    traits = F.array_compact(F.array(
        F.concat(F.floor(C("score") * 100 + 0.5).cast("string"), F.lit("% nearby")),
        F.concat("mood", F.lit(" mood")),
        F.concat("energy", F.lit(" energy")),
        F.concat(F.get("textures", F.lit(0)), F.lit(" texture")),
        F.concat(F.floor(C("bpm") + 0.5).cast("string"), F.lit(" BPM")),
        F.nullif("musical_key", F.lit("")),
    ))
    blend = F.when((C("position") <= 3) | (C("score") >= 0.85), "safer").otherwise("pivot")
    return top.select("request_id", "position", "track_id", F.concat_ws(" · ", F.slice(traits, 1, 4)).alias("reason"), blend.alias("blend"))


def answer(recommended: DataFrame, seeded: bool) -> DataFrame:
    """(request_id, answer)."""
    n = recommended.groupBy("request_id").count()
    return n.select("request_id", F.concat(F.lit("I found "), C("count").cast("string"), F.when(C("count") == 1, " record").otherwise(" records"), F.lit(" around your seed." if seeded else " in the current view.")).alias("answer"))


def seed_cards(neighbours: DataFrame, tracks: DataFrame, keep: Column, limit: int = 8) -> DataFrame:
    """(source, position, track_id): each source's neighbours that pass the filter, in their order."""
    pool = neighbours.join(rankable(tracks).where(keep), "track_id")
    return pool.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("rank"))).where(C("position") <= limit).select("source", "position", "track_id")
