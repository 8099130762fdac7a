"""Aggregations over catalogue, stages and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S

C = F.col
DONE = ["succeeded", "skipped"]
# Words for quarters of brightness and energy.
BRIGHT = ["deep", "round", "bright", "crisp"]
POWER = ["mellow", "warm", "driving", "intense"]
OUTLIERS = "Outliers / one-offs"


def terminal(max_attempts: int = 3) -> Column:
    """A stage that will not run again."""
    return C("status").isin(DONE) | ((C("status") == "failed") & ~(C("retryable") & (C("attempt_count") < max_attempts)))


def stage_progress(stages: DataFrame, keys: list[str]) -> DataFrame:
    return stages.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(terminal()).alias("done"), F.count_if(C("status") == "running").alias("running"), F.count_if(C("status") == "failed").alias("failed"))


def run_status(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Status of each run, and the first error that ended a stage; a run without stages is completed."""
    ended = terminal()
    agg = stages.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(ended).alias("done"),
        F.count_if(ended & (C("status") == "failed")).alias("lost"),
        F.min(F.when(ended & (C("status") == "failed"), F.struct("finished_at", "stage_id"))).alias("first"),
    )
    met = runs.join(agg, "run_id", "left").fillna({"total": 0, "done": 0, "lost": 0})
    over = F.when(C("cancelled"), "cancelled").when(C("lost") > 0, "failed").otherwise("completed")
    status = F.when(C("done") == C("total"), over).when(C("cancelled"), "cancel_requested").otherwise("running")
    return met.select("run_id", status.alias("status"), "total", "done", C("first.stage_id").alias("error_stage"))


def _moments(batches):
    """One row a task: of each position the number of values, their mean and the squares about it (Chan's update)."""
    import numpy as np
    import pyarrow as pa

    n = mean = squares = None
    for batch in batches:
        column = batch.column(0)
        sizes = np.diff(column.offsets.to_numpy())
        if not len(sizes) or not sizes.max():
            continue
        values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        pos = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = max(sizes.max(), 0 if n is None else len(n))
        grown = lambda x: np.zeros(wide) if x is None else np.pad(x, (0, wide - len(x)))
        n, mean, squares = grown(n), grown(mean), grown(squares)
        more = np.bincount(pos, minlength=wide).astype(float)
        own = np.bincount(pos, values, wide) / np.maximum(more, 1)
        away = np.bincount(pos, (values - own[pos]) ** 2, wide)
        total = np.maximum(n + more, 1)
        squares = squares + away + (own - mean) ** 2 * n * more / total
        n, mean = n + more, mean + (own - mean) * more / total
    if n is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in (n.tolist(), mean.tolist(), squares.tolist())], ["n", "mean", "squares"])


def dimension_stats(vectors: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(pos, mean, sd, n): mean and population deviation of each dimension; sd has epsilon added.

    A task adds its vectors up, so a row of a vector's size leaves it, whatever the number of vectors.
    """
    parts = vectors.where("embedding IS NOT NULL").select(C("embedding").cast("array<double>")).mapInArrow(_moments, "n array<double>, mean array<double>, squares array<double>")
    each = parts.select(F.posexplode(F.arrays_zip("n", "mean", "squares")).alias("pos", "p")).select("pos", "p.*")
    total = each.groupBy("pos").agg(F.sum("n").alias("n"), (F.sum(C("n") * C("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "squares")).alias("parts"))  # a row a task
    squares = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["squares"] + p["n"] * (p["mean"] - C("mean")) * (p["mean"] - C("mean")))
    return total.select("pos", "mean", (F.sqrt(squares / C("n")) + epsilon).alias("sd"), C("n").cast("long").alias("n"))


def stats_row(vectors: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """dimension_stats as one row of arrays, its size that of a vector."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "sd")))
    return dimension_stats(vectors, epsilon).agg(ordered.alias("_s")).select(C("_s.mean").alias("means"), C("_s.sd").alias("sds"))


def standardize(vectors: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """embedding -> (x - mean) / sd; dimensions without variance become 0 if there is no epsilon."""
    z = F.transform(F.arrays_zip("embedding", "means", "sds"), lambda t: F.when(t["sds"] > 0, (t["embedding"].cast("double") - t["means"]) / t["sds"]).otherwise(0.0))
    return vectors.crossJoin(F.broadcast(stats_row(vectors, epsilon))).withColumn("embedding", z).drop("means", "sds")


def _vector_sums(keys: list[str]):
    """Adds a batch's vectors up by key and dimension, so a row a batch, key and dimension travels."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select(keys)
            firsts: dict = {}
            at = np.array([firsts.setdefault(k, len(firsts)) for k in zip(*(c.to_pylist() for c in own.columns), strict=True)])
            take = np.unique(at, return_index=True)[1]
            vectors = batch.column("embedding")
            sizes = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            pos = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            wide = max(1, int(sizes.max()))
            slot = np.repeat(at, sizes) * wide + pos
            sums, n = (np.bincount(slot, w, len(firsts) * wide).reshape(-1, wide) for w in (values, None))
            arrays = [c.combine_chunks().take(pa.array(take)) for c in own.columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(n.astype(float).tolist(), pa.list_(pa.float64()))], [*keys, "s", "n"])

    return of


def pool_vectors(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector of each key's windows, and their number."""
    d = windows.where("embedding IS NOT NULL AND size(embedding) > 0").select(*keys, C("embedding").cast("array<double>"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keys)
    parts = d.mapInArrow(_vector_sums(keys), f"{kinds}, s array<double>, n array<double>")
    # what is left of a key, a row a batch, is summed by dimension
    each = parts.select(*keys, F.posexplode(F.arrays_zip("s", "n")).alias("pos", "p")).groupBy(*keys, "pos").agg(F.sum("p.s").alias("s"), F.sum("p.n").alias("n")).where("n > 0")
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", (C("s") / C("n")).alias("v")))).alias("_v"), F.max("n").cast("long").alias("n")).select(*keys, C("_v.v").alias("embedding"), "n")


def frame_errors(frames: DataFrame, dim: int) -> DataFrame:
    """Frames of another shape, or with values that aren't finite."""
    return frames.where((F.size("embedding") != dim) | ~F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))


def islands(points: DataFrame) -> DataFrame:
    """Centroid, size, name and core radius of each cluster of plotted tracks; outliers have none."""
    own = points.where("cluster >= 0")
    centres = own.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"), F.upper(F.min_by("cluster_name", "track_id")).alias("name"))
    away = F.sqrt((C("x") - C("cx")) * (C("x") - C("cx")) + (C("y") - C("cy")) * (C("y") - C("cy")))
    core = own.join(centres, "cluster").groupBy("cluster").agg(F.greatest(F.percentile(away, F.lit(0.52)), F.lit(0.16)).alias("core_radius"))
    return centres.join(core, "cluster")


def star_magnitudes(points: DataFrame) -> DataFrame:
    """Visual weight between 0.05 and 1: central, energetic tracks are brighter."""
    # a cluster's centre and reach combine before they shuffle, and are joined back
    p = points.join(points.groupBy("cluster").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy")), "cluster")
    p = p.withColumn("_d", F.sqrt((C("x") - C("_cx")) * (C("x") - C("_cx")) + (C("y") - C("_cy")) * (C("y") - C("_cy"))))
    p = p.join(p.groupBy("cluster").agg(F.max("_d").alias("_reach")), "cluster")
    central = 1 - C("_d") / F.greatest("_reach", F.lit(0.001))
    level = F.when(C("energy") == "low", 0.2).when(C("energy") == "driving", 0.74).when(C("energy") == "peak", 0.96).otherwise(0.46)
    power = F.when(C("energy_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("energy_score") / 10))).otherwise(level)
    weight = 0.07 + 0.5 * F.pow(central, F.lit(1.2)) + 0.31 * power + 0.12 * S.hash_unit(C("track_id"))
    return p.select("track_id", F.greatest(F.lit(0.05), F.least(F.lit(1.0), weight)).alias("magnitude"))


def cluster_names(members: DataFrame, features: DataFrame) -> DataFrame:
    """(cluster, name) from the tags of greatest mean, or the median tempo where there are none.

    features: (track_id, feature_key, value), keys such as genre::x. Of vibe::, clap:: and mood:: the first
    prefix that occurs anywhere is used, two tags beside genres and four alone. Where no tag occurs anywhere,
    a cluster's median brightness and energy (members' columns ``brightness`` and ``energy_rms``, where there
    are such) name it, by the quarter of all members that they fall in.
    """
    tempo = members.groupBy("cluster").agg(F.median("bpm").alias("m")).select("cluster", F.coalesce(F.concat(F.format_string("%.0f", F.bround("m", 0)), F.lit(" BPM")), F.lit("mixed tempo")).alias("tempo"))
    family = F.split("feature_key", "::", 2)
    tags = features.select("track_id", "value", family[0].alias("family"), family[1].alias("tag"))
    rank = F.array_position(F.array(F.lit("vibe"), F.lit("clap"), F.lit("mood")), C("family"))
    present = tags.agg(F.min(F.when(rank > 0, rank)).alias("vibe"), F.max(C("family") == "genre").alias("genres"))
    used = tags.crossJoin(F.broadcast(present)).where((C("family") == "genre") | (rank == C("vibe")))
    mean = used.join(members.select("track_id", "cluster"), "track_id").groupBy("cluster", (C("family") == "genre").alias("is_genre"), "tag", "genres").agg(F.avg("value").alias("v"))
    place = F.row_number().over(Window.partitionBy("cluster", "is_genre").orderBy(F.desc("v"), "tag"))
    best = mean.withColumn("_n", place).where(C("_n") <= F.when(C("is_genre") | C("genres"), 2).otherwise(4))
    text = best.groupBy("cluster", "is_genre").agg(F.concat_ws(" / ", F.array_sort(F.collect_list(F.struct("_n", "tag")))["tag"]).alias("t"))
    said = text.groupBy("cluster").agg(F.concat_ws(" · ", F.max(F.when(C("is_genre"), C("t"))), F.max(F.when(~C("is_genre"), C("t")))).alias("said"))
    tagless = tags.where((C("family") == "genre") | (rank > 0)).agg((F.count("*") == 0).alias("tagless"))
    shares = None
    for column, words in (("brightness", BRIGHT), ("energy_rms", POWER)):
        share = _median_share(members, column).select("cluster", F.element_at(F.array(*map(F.lit, words)), F.least(F.floor(C("share") * 4), F.lit(3)).cast("int") + 1).alias(column))
        shares = share if shares is None else shares.join(share, "cluster")
    felt = F.concat(C("brightness"), F.lit(" & "), C("energy_rms"), F.lit(" · "), C("tempo"))
    out = tempo.join(said, "cluster", "left").join(shares, "cluster").crossJoin(F.broadcast(tagless))
    named = F.when(C("tagless"), felt).otherwise(F.coalesce(F.nullif("said", F.lit("")), C("tempo")))
    return out.select("cluster", F.when(C("cluster") == -1, OUTLIERS).otherwise(named).alias("name"))


def _median_share(members: DataFrame, column: str) -> DataFrame:
    """(cluster, share): of all values of a column the share below the cluster's median; 0.5 where there is none."""
    if column not in members.columns:
        return members.select("cluster").distinct().withColumn("share", F.lit(0.5))
    medians = members.groupBy("cluster").agg(F.median(column).alias("_m"))
    known = members.where(C(column).isNotNull())
    below = known.join(F.broadcast(medians.where("_m IS NOT NULL").select(C("cluster").alias("c"), C("_m").alias("m"))), C(column) < C("m")).groupBy("c").agg(F.count("*").alias("below"))  # clusters are a few dozen
    n = known.agg(F.count("*").alias("n"))
    return medians.join(below, C("cluster") == C("c"), "left").crossJoin(F.broadcast(n)).select("cluster", F.when(C("_m").isNull(), 0.5).otherwise(F.coalesce("below", F.lit(0)) / C("n")).alias("share"))


def cluster_summary(assigned: DataFrame, run_id: str) -> DataFrame:
    """Size, name and moment of each cluster; the moment is that of its first track; a run of one track is solo."""
    total = assigned.agg(F.count("*").alias("_total"))
    out = assigned.groupBy("cluster").agg(F.count("*").alias("track_count"), F.min("cluster_name").alias("name"), F.min_by("moment", "track_id").alias("moment"))
    out = out.crossJoin(F.broadcast(total))
    return out.select(F.sha2(F.concat_ws(":", F.lit(run_id), C("cluster").cast("string")), 256).alias("cluster_id"), "cluster", F.when(C("_total") == 1, "solo").otherwise(C("name")).alias("name"), "moment", "track_count")


def bpm_bounds(tracks: DataFrame) -> DataFrame:
    """(low, high) of all finite tempos, 108 to 136 without any; never empty."""
    b = tracks.agg(F.min(F.floor(S.finite(C("bpm")))).alias("a"), F.max(F.ceil(S.finite(C("bpm")))).alias("b"))
    same = C("a") == C("b")
    return b.select(F.when(C("a").isNull(), 108).when(same, F.greatest(F.lit(1), C("a") - 1)).otherwise(C("a")).cast("long").alias("low"), F.when(C("a").isNull(), 136).when(same, C("a") + 1).otherwise(C("b")).cast("long").alias("high"))


def genres(tracks: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct genres in alphabetical order whatever their case, with how many tracks have each."""
    out = tracks.groupBy(F.trim("genre").alias("genre")).count().where("genre <> ''").orderBy(F.lower("genre"), "genre")
    return out if limit is None else out.limit(limit)


def import_summary(matched: DataFrame, tracks: DataFrame) -> DataFrame:
    """Counts of an import: matched rows carry status, bpm_conflict, key_conflict and filled (fields filled in)."""
    n = lambda c: F.count_if(c)
    counts = matched.agg(F.count("*").alias("rows"), *[n(C("status") == s).alias(s) for s in ("matched", "unmatched", "ambiguous")], n(C("filled") > 0).alias("enriched"), F.coalesce(F.sum("filled"), F.lit(0)).alias("fields"), n(C("bpm_conflict")).alias("bpm_conflicts"), n(C("key_conflict")).alias("key_conflicts"))
    return counts.crossJoin(tracks.agg(F.count("*").alias("tracks")))


def import_outcomes(files: DataFrame, known: DataFrame) -> DataFrame:
    """Status of each scanned file; duplicate_of is the oldest track with the same content, in any library."""
    oldest = known.groupBy("content_hash").agg(F.min_by("track_id", F.struct("created_at", "track_id")).alias("duplicate_of"))
    met = files.join(oldest, "content_hash", "left")
    status = F.when(C("failed"), "failed").when(~C("suffix").isin(S.AUDIO_SUFFIXES), "unsupported").when(C("duplicate_of").isNotNull(), "duplicate").otherwise("imported")
    return met.withColumn("status", status).withColumn("duplicate_of", F.when(C("status") == "duplicate", C("duplicate_of"))).withColumn("warning", F.when((C("status") == "imported") & (S.text(C("artist")) == ""), "missing_metadata"))


def coverage(tracks: DataFrame) -> DataFrame:
    have = {c: F.count_if(S.text(C(c).cast("string")) != "").alias(c) for c in ("bpm", "musical_key", "genre", "energy_rating")}
    return tracks.agg(F.count("*").alias("total"), *have.values())


def manifest_summary(declared: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Readiness of each track from what its manifest's extractors did. declared: (track_id, extractor, required)."""
    met = declared.join(outcomes, ["track_id", "extractor"], "full")
    n = F.count_if
    good = C("status") == "succeeded"
    agg = met.groupBy("track_id").agg(
        n(C("required") & good).alias("required_succeeded"),
        n(C("required") & ~F.coalesce(good, F.lit(False))).alias("required_failed"),
        n(~C("required") & ~F.coalesce(good, F.lit(False))).alias("optional_failed"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        n(C("required").isNull()).alias("undeclared"),
    )
    ready = F.when(C("undeclared") > 0, "rejected").when(C("required_failed") > 0, "failed").when(C("optional_failed") > 0, "degraded").otherwise("ready_deep")
    return agg.withColumn("readiness", ready)


def best_run(members: DataFrame, wanted: DataFrame, share: float = 0.7) -> DataFrame:
    """Coordinates of the run with the most wanted tracks; none if it has too few of them."""
    own = members.join(wanted, "track_id", "left_semi").where(S.finite(C("x")).isNotNull() & S.finite(C("y")).isNotNull())
    top = own.groupBy("run_id").count().orderBy(F.desc("count"), "run_id").limit(1).crossJoin(wanted.agg(F.count("*").alias("_wanted")))
    return own.join(F.broadcast(top.where(C("count") >= share * C("_wanted")).select("run_id")), "run_id", "left_semi")
