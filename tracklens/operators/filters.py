"""Filters over studio tracks, and the projections that prepare them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions import scalars as S

C = F.col
BPM_BOUNDS = (108.0, 136.0)


def plot_rows(tracks: DataFrame) -> DataFrame:
    """Tracks with finite coordinates; cluster from its id, -1 if that is no number; names filled in."""
    cluster = F.coalesce(C("cluster_id").try_cast("int"), F.lit(-1))
    named = F.when(cluster < 0, "Outliers / one-offs").otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))
    return (
        tracks.where(S.finite(C("x")).isNotNull() & S.finite(C("y")).isNotNull())
        .withColumn("cluster", cluster)
        .withColumn("cluster_name", named)
        .withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
        .withColumn("artist", F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown artist")))
        .withColumn("bpm", S.finite(C("bpm")))
    )


def studio_rows(tracks: DataFrame) -> DataFrame:
    """Enumerations outside their values get the default; missing coordinates come from the id's hash."""
    ring = S.hash_point(C("track_id"), 1.8, 80, 50.0)
    return (
        tracks.withColumn("mood", F.when(C("mood").isin(S.MOODS), C("mood")).otherwise("warm"))
        .withColumn("energy", F.when(C("energy").isin(S.ENERGIES), C("energy")).otherwise("medium"))
        .withColumn("textures", F.coalesce(F.filter("textures", lambda t: t.isin(S.TEXTURES)), F.array(F.lit("minimal"))))
        .withColumn("cluster_name", F.when(C("cluster").isNull(), "Unanalyzed").otherwise(F.concat(F.lit("Cluster "), C("cluster").cast("string"))))
        .withColumn("cluster", F.coalesce("cluster", F.lit(0)))
        .withColumn("x", F.coalesce("x", ring["x"]))
        .withColumn("y", F.coalesce("y", ring["y"]))
    )


@dataclass
class StudioFilter:
    query: str = ""
    bpm: tuple[float, float] = BPM_BOUNDS
    keys: list[str] = field(default_factory=list)
    moods: list[str] = field(default_factory=list)
    energies: list[str] = field(default_factory=list)
    textures: list[str] = field(default_factory=list)
    genres: list[str] = field(default_factory=list)
    compatible_keys: bool = False
    bpm_near_seed: bool = False


def studio_predicate(f: StudioFilter, seed: dict | None = None, bounds: tuple[float, float] = BPM_BOUNDS) -> Column:
    """Rows that the studio shows. ``seed``: bpm and musical_key of the track to stay near."""
    low, high = f.bpm
    active = low > bounds[0] or high < bounds[1]
    keep = F.when(C("bpm").isNull(), not active).otherwise(C("bpm").between(low, high))
    if f.query.strip():
        words = F.lower(F.concat_ws(" ", *[S.text(C(c)) for c in ("title", "artist", "label", "genre", "mood", "cluster_name")]))
        keep = keep & F.contains(words, F.lit(f.query.strip().lower()))
    for column, values in (("musical_key", f.keys), ("mood", f.moods), ("energy", f.energies)):
        if values:
            keep = keep & F.coalesce(C(column).isin(values), F.lit(False))
    if f.textures:
        keep = keep & F.arrays_overlap("textures", F.array(*map(F.lit, f.textures)))
    if f.genres:
        keep = keep & F.lower(F.trim(S.text(C("genre")))).isin([g.strip().lower() for g in f.genres])
    if f.compatible_keys and seed:
        keep = keep & S.keys_compatible(F.lit(seed.get("musical_key")), C("musical_key"))
    if f.bpm_near_seed and seed and seed.get("bpm") is not None:
        keep = keep & F.coalesce(F.abs(C("bpm") - seed["bpm"]) <= 4, F.lit(False))
    return keep


def map_predicate(bpm_min: float | None = None, bpm_max: float | None = None, clusters: list[int] | None = None, moods: list[str] | None = None) -> Column:
    """Rows that the map shows; a track without bpm fails a bpm limit."""
    keep = F.lit(True)
    if bpm_min is not None:
        keep = keep & F.coalesce(C("bpm") >= bpm_min, F.lit(False))
    if bpm_max is not None:
        keep = keep & F.coalesce(C("bpm") <= bpm_max, F.lit(False))
    if clusters:
        keep = keep & C("cluster").isin(clusters)
    if moods:
        keep = keep & F.lower("mood").isin([m.lower() for m in moods])
    return keep


def merge_filters(specs: DataFrame) -> DataFrame:
    """Conjunction of filters (a_..., b_...): tighter limits; the common values of two lists, else the one given."""
    both = lambda a, b: F.when(F.size(_ints(a)) == 0, b).when(F.size(_ints(b)) == 0, a).otherwise(F.array_intersect(a, b))
    return specs.withColumns({"bpm_min": F.greatest("a_bpm_min", "b_bpm_min"), "bpm_max": F.least("a_bpm_max", "b_bpm_max"), "clusters": both(C("a_clusters"), C("b_clusters"))})


def _ints(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<int>"))


def library_view(tracks: DataFrame, plays: DataFrame, kind: str, cutoff=None, focus: DataFrame | None = None) -> DataFrame:
    """``unplayed``: no row in plays; ``recent``: created at or after the cutoff; ``focus``: ids of another table."""
    if kind == "unplayed":
        return tracks.join(plays.select("track_id"), "track_id", "left_anti")
    if kind == "recent":
        return tracks.where(C("created_at") >= cutoff)
    return tracks.join(focus.select("track_id"), "track_id", "left_semi")


def search_page(tracks: DataFrame, said: str, offset: int, limit: int) -> DataFrame:
    """Newest first, a page of those whose title or artist holds the words."""
    low = said.strip().lower()
    return tracks.where(F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("artist"), F.lit(low))).orderBy(F.desc("created_at"), "track_id").offset(offset).limit(limit)


def visible_to(rows: DataFrame, libraries: DataFrame, owner) -> DataFrame:
    """Rows of the owner's libraries and of shared demo libraries."""
    return rows.join(libraries.where((C("owner_id") == owner) | (C("source") == "demo")), "library_id", "left_semi")


def rankable(tracks: DataFrame) -> DataFrame:
    return tracks.where((F.coalesce("analysis_status", F.lit("")) != "failed") & ~F.coalesce("hidden", F.lit(False)))
