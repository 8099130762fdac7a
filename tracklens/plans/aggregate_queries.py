"""Aggregations, ranks, evaluation and checks (A*, W*, V*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.operators import aggregates, evaluation, filters, joins, merges, ranking, validate
from tracklens.plans.adapters import view
from tracklens.plans.base import query
from tracklens.plans.join_queries import FILL, IDENT, J1_SQL, RESULTS, STUDIO, TRIPLETS, identity_match, results, studio, triplets
from tracklens.plans.scalar_queries import ENERGY_SQL, MOMENT_SQL, fnv_sql

C = F.col
TERMINAL = "(status IN ('succeeded', 'skipped') OR (status = 'failed' AND NOT (retryable AND attempt_count < 3)))"


@query("a1_stage_progress", f"SELECT run_id, track_id, count(*) AS total, count(*) FILTER ({TERMINAL}) AS done, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed FROM stages GROUP BY ALL", "stages")
def a1(spark, sf):
    return aggregates.stage_progress(view(spark, sf, "stages"), ["run_id", "track_id"])


@query("a2_run_status", f"""
WITH a AS (SELECT run_id, count(*) AS total, count(*) FILTER ({TERMINAL}) AS done, count(*) FILTER ({TERMINAL} AND status = 'failed') AS lost, arg_min(CASE WHEN {TERMINAL} AND status = 'failed' THEN stage_id END, CASE WHEN {TERMINAL} AND status = 'failed' THEN (finished_at, stage_id) END) AS error_stage FROM stages GROUP BY run_id)
SELECT o_orderkey AS run_id, CASE WHEN coalesce(done, 0) = coalesce(total, 0) THEN CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN lost > 0 THEN 'failed' ELSE 'completed' END WHEN o_orderstatus = 'P' THEN 'cancel_requested' ELSE 'running' END AS status, coalesce(total, 0) AS total, coalesce(done, 0) AS done, error_stage FROM orders LEFT JOIN a ON run_id = o_orderkey""", "stages")
def a2(spark, sf):
    runs = view(spark, sf, "orders").select(C("o_orderkey").alias("run_id"), (C("o_orderstatus") == "P").alias("cancelled"))
    return aggregates.run_status(runs, view(spark, sf, "stages"))


STATS = "d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings)"


@query("a3_dimension_stats", f"WITH {STATS} SELECT pos::INT AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n FROM d GROUP BY pos")
def a3(spark, sf):
    return aggregates.dimension_stats(view(spark, sf, "embeddings")).select("pos", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query("a4_standardized", f"""
WITH {STATS}, m AS (SELECT pos, avg(v) AS mean, stddev_pop(v) + 1e-8 AS sd FROM d GROUP BY pos) SELECT vec_id, round(sum((v - mean) / sd), 5) AS total, round(max(CASE WHEN pos = 0 THEN (v - mean) / sd END), 5) AS first FROM d JOIN m USING (pos) GROUP BY vec_id""")
def a4(spark, sf):
    z = aggregates.standardize(view(spark, sf, "embeddings"), 1e-8)
    return z.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(C("embedding")[0], 5).alias("first"))


@query("a5_pooled_vectors", f"WITH {STATS}, p AS (SELECT label, pos, avg(v) AS v, count(*) AS n FROM d GROUP BY label, pos) SELECT label, max(n) AS n, round(sum(v), 5) AS total, round(max(CASE WHEN pos = 3 THEN v END), 6) AS fourth FROM p GROUP BY label")
def a5(spark, sf):
    p = aggregates.pool_vectors(view(spark, sf, "embeddings"), ["label"])
    return p.select("label", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(C("embedding")[3], 6).alias("fourth"))


@query("a6_frame_pooling", f"WITH {STATS}, p AS (SELECT vec_id // 4 AS track_id, pos, avg(v) AS v FROM d WHERE vec_id % 10 <> 3 GROUP BY ALL) SELECT track_id, round(max(CASE WHEN pos = 1 THEN v END), 6) AS second FROM p GROUP BY track_id")
def a6(spark, sf):
    frames = view(spark, sf, "embeddings").selectExpr("CAST(vec_id DIV 4 AS BIGINT) AS track_id", "vec_id", "CASE WHEN vec_id % 10 = 3 THEN slice(embedding, 1, 8) ELSE embedding END AS embedding")
    good = frames.join(aggregates.frame_errors(frames, 64).select("vec_id"), "vec_id", "left_anti")
    return aggregates.pool_vectors(good, ["track_id"]).select("track_id", F.round(C("embedding")[1], 6).alias("second"))


ISLANDS = """c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS n, upper(concat('Cluster ', cluster)) AS name FROM tracks WHERE cluster > 0 GROUP BY cluster),
i AS (SELECT c.cluster, cx, cy, n, name, greatest(quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 0.52), 0.16) AS core_radius FROM c JOIN tracks t ON t.cluster = c.cluster GROUP BY ALL)"""


def plotted(spark, sf):
    t = view(spark, sf, "tracks")
    return filters.plot_rows(t.withColumn("cluster_id", F.when(C("cluster") > 0, C("cluster").cast("string"))).drop("cluster"))


@query("a7_islands", f"WITH {ISLANDS} SELECT cluster, name, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(core_radius, 6) AS core_radius FROM i", "tracks")
def a7(spark, sf):
    return aggregates.islands(plotted(spark, sf)).select("cluster", "name", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "core_radius")])


@query("a8_cluster_names", """
WITH m AS (SELECT track_id, CASE WHEN cluster = 0 THEN -1 ELSE cluster END AS cluster, bpm FROM tracks),
f AS (SELECT track_id, 'g' || (vec % 4) AS tag, 'genre' AS family, (vec * 7 % 101)::DOUBLE AS value FROM (SELECT *, CAST(substr(track_id, 2) AS INT) AS vec FROM tracks) WHERE cluster < 5 UNION ALL SELECT track_id, 'v' || (vec % 5), 'clap', (vec * 11 % 103)::DOUBLE FROM (SELECT *, CAST(substr(track_id, 2) AS INT) AS vec FROM tracks) WHERE cluster < 5),
a AS (SELECT cluster, family, tag, avg(value) AS v FROM f JOIN m USING (track_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster, family ORDER BY v DESC, tag) AS n FROM a),
s AS (SELECT cluster, string_agg(tag, ' / ' ORDER BY n) FILTER (family = 'genre') || ' · ' || string_agg(tag, ' / ' ORDER BY n) FILTER (family = 'clap') AS said FROM r WHERE n <= 2 GROUP BY cluster),
p AS (SELECT CASE WHEN cluster = 0 THEN -1 ELSE cluster END AS cluster, created_at, duration_sec, bpm FROM tracks), t AS (SELECT cluster, median(bpm) AS b, median(created_at) AS light, median(duration_sec) AS power FROM p GROUP BY cluster),
q AS (SELECT t.cluster, least(3, floor(4.0::DOUBLE * count(*) FILTER (p.created_at < light) / count(*))::INT) AS l, least(3, floor(4.0::DOUBLE * count(*) FILTER (p.duration_sec < power) / count(*))::INT) AS e FROM t, p GROUP BY t.cluster)
SELECT t.cluster, CASE WHEN t.cluster = -1 THEN 'Outliers / one-offs' ELSE coalesce(said, format('{} BPM', round_even(b, 0)::INT)) END AS name,
 CASE WHEN t.cluster = -1 THEN 'Outliers / one-offs' ELSE concat(['deep', 'round', 'bright', 'crisp'][l + 1], ' & ', ['mellow', 'warm', 'driving', 'intense'][e + 1], ' · ', format('{} BPM', round_even(b, 0)::INT)) END AS felt FROM t JOIN q USING (cluster) LEFT JOIN s USING (cluster)""", "tracks")
def a8(spark, sf):
    t = view(spark, sf, "tracks").withColumn("vec", F.substring("track_id", 2, 9).cast("int"))
    members = t.select("track_id", F.when(C("cluster") == 0, -1).otherwise(C("cluster")).alias("cluster"), "bpm")
    low = t.where("cluster < 5")
    f = low.selectExpr("track_id", "concat('genre::g', vec % 4) AS feature_key", "CAST(vec * 7 % 101 AS DOUBLE) AS value").union(low.selectExpr("track_id", "concat('clap::v', vec % 5)", "CAST(vec * 11 % 103 AS DOUBLE)"))
    felt = t.select("track_id", F.when(C("cluster") == 0, -1).otherwise(C("cluster")).alias("cluster"), "bpm", C("created_at").alias("brightness"), C("duration_sec").alias("energy_rms"))
    return aggregates.cluster_names(members, f).join(aggregates.cluster_names(felt, f.limit(0)).withColumnRenamed("name", "felt"), "cluster")


@query("a9_cluster_summary", f"""
WITH s AS (SELECT track_id, cluster, {MOMENT_SQL} AS moment FROM (SELECT *, coalesce(bpm, 122) AS b, coalesce(energy_rating, 5) / CAST(10 AS DOUBLE) AS e, created_at / CAST(1000 AS DOUBLE) AS v FROM tracks))
SELECT sha256(concat('r1:', cluster)) AS cluster_id, cluster, concat('Cluster ', cluster) AS name, arg_min(moment, track_id) AS moment, count(*) AS track_count FROM s GROUP BY cluster""", "tracks")
def a9(spark, sf):
    t = view(spark, sf, "tracks").withColumn("moment", S.suggested_moment(C("bpm"), F.coalesce("energy_rating", F.lit(5)) / 10, C("created_at") / 1000)).withColumn("cluster_name", F.concat(F.lit("Cluster "), C("cluster").cast("string")))
    return aggregates.cluster_summary(t, "r1")


@query("a10_solo_cluster", "SELECT sha256('r1:2') AS cluster_id, cluster, 'solo' AS name, 1::BIGINT AS track_count FROM tracks WHERE track_id = (SELECT min(track_id) FROM tracks WHERE cluster = 2)", "tracks")
def a10(spark, sf):
    t = view(spark, sf, "tracks").where("cluster = 2").orderBy("track_id").limit(1)
    return aggregates.cluster_summary(t.withColumn("moment", F.lit("Main floor")).withColumn("cluster_name", F.lit("one")), "r1").select("cluster_id", "cluster", "name", "track_count")


@query("a11_bpm_bounds", "SELECT floor(min(bpm))::BIGINT AS low, ceil(max(bpm))::BIGINT AS high FROM tracks", "tracks")
def a11(spark, sf):
    return aggregates.bpm_bounds(view(spark, sf, "tracks"))


@query("a12_genres", "SELECT genre, count(*) AS count FROM tracks WHERE genre <> '' GROUP BY genre", "tracks")
def a12(spark, sf):
    return aggregates.genres(view(spark, sf, "tracks"))


@query("a13_import_summary", f"""
WITH m AS ({J1_SQL.strip().replace('WITH ', 'WITH ', 1)}) SELECT count(*) AS rows, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status = 'ambiguous') AS ambiguous,
 count(*) FILTER (m.status = 'matched' AND t.bpm IS NULL) AS enriched, count(*) FILTER (m.status = 'matched' AND t.bpm IS NULL) AS fields, coalesce(count(*) FILTER (t.bpm <> 120), 0) AS bpm_conflicts, count(*) FILTER (t.musical_key NOT IN ('', '8A')) AS key_conflicts, (SELECT count(*) FROM tracks) AS tracks FROM m LEFT JOIN tracks t ON t.track_id = m.matched_track_id""", "tracks")
def a13(spark, sf):
    t = view(spark, sf, "tracks")
    met = identity_match(spark, sf).select("event_id", "status", C("matched_track_id").alias("track_id")).join(t.select("track_id", "bpm", "musical_key"), "track_id", "left")
    met = met.withColumns({"bpm_conflict": merges.bpm_conflict(C("bpm"), F.lit(120.0)), "key_conflict": F.coalesce(merges.key_conflict(C("musical_key"), F.lit("8A")), F.lit(False)), "filled": F.when((C("status") == "matched") & C("bpm").isNull(), 1).otherwise(0)})
    return aggregates.import_summary(met, t)


@query("a14_import_outcomes", """
WITH k AS (SELECT event_id % 97 AS h, arg_min(event_id, (user_id, event_id)) AS d FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'unsupported' WHEN d IS NOT NULL THEN 'duplicate' ELSE 'imported' END AS status, CASE WHEN event_id % 31 <> 0 AND event_id % 7 <> 0 THEN d END AS duplicate_of FROM events LEFT JOIN k ON event_id % 120 = h WHERE event_type = 'view'""")
def a14(spark, sf):
    e = view(spark, sf, "events")
    known = e.where("event_type = 'click'").selectExpr("event_id AS track_id", "event_id % 97 AS content_hash", "user_id AS created_at")
    files = e.where("event_type = 'view'").selectExpr("event_id", "event_id % 120 AS content_hash", "event_id % 31 = 0 AS failed", "CASE WHEN event_id % 7 = 0 THEN '.txt' ELSE '.wav' END AS suffix", "'a' AS artist")
    return aggregates.import_outcomes(files, known).select("event_id", "status", "duplicate_of")


@query("a15_coverage", "SELECT count(*) AS total, count(bpm) AS bpm, count(nullif(musical_key, '')) AS musical_key, count(nullif(genre, '')) AS genre, count(energy_rating) AS energy_rating FROM tracks", "tracks")
def a15(spark, sf):
    return aggregates.coverage(view(spark, sf, "tracks"))


ACCEPTED = "SELECT configuration_id, dimension, avg(CASE WHEN judgment = 'similar' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS value, count(*) AS sample_count FROM judgments WHERE judgment <> 'skip' GROUP BY ALL"
NDCG = """SELECT configuration_id, dimension, CASE WHEN sum((pow(2, ordinal_rating) - 1) / log2(i + 1)) > 0 THEN sum((pow(2, ordinal_rating) - 1) / log2(rank_position + 1)) / sum((pow(2, ordinal_rating) - 1) / log2(i + 1)) ELSE 0 END AS value, count(*) AS sample_count
 FROM (SELECT *, row_number() OVER (PARTITION BY configuration_id, dimension ORDER BY ordinal_rating DESC) AS i FROM (SELECT *, row_number() OVER (PARTITION BY configuration_id, dimension ORDER BY rank_position, judgment_id) AS n FROM judgments) WHERE n <= 10) GROUP BY configuration_id, dimension"""
TRIPLET_SQL = f"""SELECT t.configuration_id, dimension, avg(CASE WHEN (decision = 'a_closer') = (ra.rank < rb.rank) AND ra.rank <> rb.rank THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS value, count(*) AS sample_count FROM triplets t JOIN results ra ON t.configuration_id = ra.configuration_id AND t.anchor_track_id = ra.anchor_track_id AND t.candidate_a = ra.candidate_track_id
 JOIN results rb ON t.configuration_id = rb.configuration_id AND t.anchor_track_id = rb.anchor_track_id AND t.candidate_b = rb.candidate_track_id WHERE decision IN ('a_closer', 'b_closer') GROUP BY ALL"""


def rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("a16_accepted_at_k", f"SELECT configuration_id, dimension, round(value, 6) AS value, sample_count FROM ({ACCEPTED})", "judgments")
def a16(spark, sf):
    return rounded(evaluation.accepted_at_k(view(spark, sf, "judgments")))


@query("a17_ndcg", f"SELECT configuration_id, dimension, round(value, 6) AS value, sample_count FROM ({NDCG})", "judgments")
def a17(spark, sf):
    return rounded(evaluation.ndcg(view(spark, sf, "judgments")))


@query("a18_triplet_accuracy", f"WITH {RESULTS}, {TRIPLETS} SELECT configuration_id, dimension, round(value, 6) AS value, sample_count FROM ({TRIPLET_SQL})", "tracks judgments")
def a18(spark, sf):
    return rounded(evaluation.triplet_accuracy(joins.frozen_ranks(triplets(spark, sf), results(spark, sf))))


@query("a19_silent_configurations", f"SELECT c AS configuration_id, coalesce(dimension, 'overall') AS dimension, round(value, 6) AS value, coalesce(sample_count, 0) AS sample_count FROM (SELECT unnest(['c1', 'c2', 'c3']) AS c) LEFT JOIN ({ACCEPTED}) a ON a.configuration_id = c", "judgments")
def a19(spark, sf):
    configs = spark.range(1).select(F.explode(F.array(*map(F.lit, ("c1", "c2", "c3")))).alias("configuration_id"))
    return rounded(evaluation.with_silent(evaluation.accepted_at_k(view(spark, sf, "judgments")), configs))


@query("a20_operational_metrics", "SELECT configuration_id, metric_name, value FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'c1' WHEN 1 THEN 'c2' ELSE 'c9' END AS configuration_id, event_type AS metric_name, value, row_number() OVER (PARTITION BY event_id % 3, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND configuration_id <> 'c9'")
def a20(spark, sf):
    m = view(spark, sf, "events").selectExpr("CASE event_id % 3 WHEN 0 THEN 'c1' WHEN 1 THEN 'c2' ELSE 'c9' END AS configuration_id", "event_type AS metric_name", "value", "event_id AS seq")
    configs = spark.range(1).select(F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("configuration_id"))
    return evaluation.own_metrics(m, configs).select("configuration_id", "metric_name", "value")


def metrics(spark, sf):
    j = view(spark, sf, "judgments")
    parts = {"accepted_at_10": evaluation.accepted_at_k(j), "ndcg_at_10": evaluation.ndcg(j), "triplet_accuracy": evaluation.triplet_accuracy(joins.frozen_ranks(triplets(spark, sf), results(spark, sf)))}
    out = None
    for name, df in parts.items():
        part = df.select("configuration_id", "dimension", F.lit(name).alias("metric_name"), F.lit(10).alias("k"), "value", "sample_count")
        out = part if out is None else out.union(part)
    return out


METRICS = f"metrics AS (SELECT *, 'accepted_at_10' AS metric_name FROM ({ACCEPTED}) UNION ALL SELECT *, 'ndcg_at_10' FROM ({NDCG}) UNION ALL SELECT *, 'triplet_accuracy' FROM ({TRIPLET_SQL}))"


@query("a21_configuration_report", f"""
WITH {RESULTS}, {TRIPLETS}, {METRICS} SELECT configuration_id, round(max(value) FILTER (metric_name = 'ndcg_at_10' AND dimension = 'overall'), 6) AS ndcg_at_10, round(max(value) FILTER (metric_name = 'triplet_accuracy' AND dimension = 'overall'), 6) AS triplet_accuracy, max(sample_count) AS judgment_count FROM metrics GROUP BY configuration_id""", "tracks judgments")
def a21(spark, sf):
    r = evaluation.configuration_report(metrics(spark, sf), ["ndcg_at_10", "triplet_accuracy"])
    return r.select("configuration_id", F.round("ndcg_at_10", 6).alias("ndcg_at_10"), F.round("triplet_accuracy", 6).alias("triplet_accuracy"), "judgment_count")


@query("a22_manifest_summary", """
WITH s AS (SELECT run_id, extractor, min(status) AS status, max(attempt_count) AS attempts FROM stages GROUP BY ALL), d AS (SELECT o_orderkey AS run_id, unnest(['librosa', 'clap', 'essentia']) AS extractor FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT coalesce(d.run_id, s.run_id) AS track_id, d.extractor = 'librosa' AS required, coalesce(status, '') = 'succeeded' AS good, attempts, d.extractor IS NULL AS undeclared FROM d FULL JOIN s ON d.run_id = s.run_id AND d.extractor = s.extractor)
SELECT track_id, count(*) FILTER (required AND good) AS required_succeeded, count(*) FILTER (required AND NOT good) AS required_failed, count(*) FILTER (NOT required AND NOT good) AS optional_failed, coalesce(sum(attempts), 0)::BIGINT AS attempts, count(*) FILTER (undeclared) AS undeclared,
 CASE WHEN count(*) FILTER (undeclared) > 0 THEN 'rejected' WHEN count(*) FILTER (required AND NOT good) > 0 THEN 'failed' WHEN count(*) FILTER (NOT required AND NOT good) > 0 THEN 'degraded' ELSE 'ready_deep' END AS readiness FROM m GROUP BY track_id""", "stages")
def a22(spark, sf):
    outcomes = view(spark, sf, "stages").groupBy(C("run_id").alias("track_id"), "extractor").agg(F.min("status").alias("status"), F.max("attempt_count").alias("attempts"))
    declared = view(spark, sf, "orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("track_id"), F.explode(F.array(*map(F.lit, ("librosa", "clap", "essentia")))).alias("extractor")).withColumn("required", C("extractor") == "librosa")
    return aggregates.manifest_summary(declared, outcomes)


@query("a24_best_run", "SELECT track_id, round(x, 6) AS x FROM tracks", "tracks")
def a24(spark, sf):
    t = view(spark, sf, "tracks")
    members = t.select("track_id", F.lit("full").alias("run_id"), "x", "y").union(t.where("cluster < 8").select("track_id", F.lit("part"), "y", "x"))
    return aggregates.best_run(members, t.select("track_id")).select("track_id", F.round("x", 6).alias("x"))


@query("a25_neighbour_summary", f"WITH {RESULTS} SELECT count(DISTINCT anchor_track_id) AS sources, count(*) AS neighbours, count(DISTINCT configuration_id) AS models FROM results", "tracks")
def a25(spark, sf):
    return results(spark, sf).agg(F.count_distinct("anchor_track_id").alias("sources"), F.count("*").alias("neighbours"), F.count_distinct("configuration_id").alias("models"))


@query("a26_view_counts", "SELECT count(*) AS total, count(*) FILTER (bpm >= 120) AS visible, count(*) FILTER (bpm >= 120 AND cluster = 3) AS in_cluster FROM tracks", "tracks")
def a26(spark, sf):
    seen = filters.map_predicate(bpm_min=120)
    return view(spark, sf, "tracks").agg(F.count("*").alias("total"), F.count_if(seen).alias("visible"), F.count_if(seen & (C("cluster") == 3)).alias("in_cluster"))


@query("a27_anchors_complete", "SELECT count(*) FILTER (n >= 1250) AS complete, count(*) AS anchors FROM (SELECT anchor_track_id, count(*) AS n FROM judgments GROUP BY ALL)", "judgments")
def a27(spark, sf):
    n = view(spark, sf, "judgments").groupBy("anchor_track_id").count()
    return n.agg(F.count_if(C("count") >= 1250).alias("complete"), F.count("*").alias("anchors"))


@query("w1_strict_percentile", "SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1) / CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE), 9) AS pct FROM lineitem")
def w1(spark, sf):
    return ranking.strict_percentile(view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", F.round("pct", 9).alias("pct"))


@query("w2_latest_row", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def w2(spark, sf):
    return ranking.latest(view(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w3_latest_run", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def w3(spark, sf):
    return view(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"))


@query("w4_top_k", "SELECT o_custkey, o_orderkey, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def w4(spark, sf):
    return ranking.top_k(view(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("w5_neighbour_lookup", f"WITH {RESULTS} SELECT configuration_id, candidate_track_id, rank::INT AS rank FROM results WHERE anchor_track_id = 't000003' ORDER BY configuration_id, rank LIMIT 60", "tracks")
def w5(spark, sf):
    return results(spark, sf).where("anchor_track_id = 't000003'").orderBy("configuration_id", "rank").limit(60).select("configuration_id", "candidate_track_id", "rank")


@query("w6_rerank", f"WITH {RESULTS} SELECT * FROM (SELECT anchor_track_id, configuration_id, candidate_track_id, row_number() OVER (PARTITION BY anchor_track_id, configuration_id ORDER BY rank)::INT AS rank FROM results JOIN tracks ON track_id = candidate_track_id WHERE library_id = 'L2') WHERE rank <= 10", "tracks")
def w6(spark, sf):
    pool = view(spark, sf, "tracks").where("library_id = 'L2'").select(C("track_id").alias("candidate_track_id"))
    own = results(spark, sf).withColumnRenamed("rank", "source_rank").join(pool, "candidate_track_id", "left_semi")
    return ranking.top_k(own, ["anchor_track_id", "configuration_id"], ["source_rank", "candidate_track_id"], 10).select("anchor_track_id", "configuration_id", "candidate_track_id", "rank")


@query("w7_next_anchor", """
WITH a AS (SELECT DISTINCT anchor_track_id FROM judgments), e AS (SELECT DISTINCT evaluator_id FROM judgments WHERE judgment_id % 3 = 0), d AS (SELECT evaluator_id, anchor_track_id, count(*) AS n FROM judgments WHERE judgment_id % 3 = 0 GROUP BY ALL)
SELECT evaluator_id, arg_min(anchor_track_id, (coalesce(n, 0), anchor_track_id)) AS anchor_track_id, min(coalesce(n, 0)) AS judged FROM a CROSS JOIN e LEFT JOIN d USING (evaluator_id, anchor_track_id) GROUP BY evaluator_id""", "judgments")
def w7(spark, sf):
    j = view(spark, sf, "judgments")
    done = j.where("judgment_id % 3 = 0")
    anchors = j.select("anchor_track_id").distinct().withColumn("created_at", F.lit(0))
    return ranking.next_anchor(anchors, done, done.select("evaluator_id").distinct()).select("evaluator_id", "anchor_track_id", "judged")


@query("w8_metric_winners", f"""
WITH {RESULTS}, {TRIPLETS}, {METRICS} SELECT metric_name, dimension, configuration_id, round(value, 6) AS value, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER w AS n, value - lead(value) OVER w AS delta FROM metrics WINDOW w AS (PARTITION BY metric_name, dimension ORDER BY value DESC, configuration_id)) WHERE n = 1""", "tracks judgments")
def w8(spark, sf):
    return ranking.metric_winners(metrics(spark, sf)).select("metric_name", "dimension", "configuration_id", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


@query("w9_largest_islands", f"WITH {ISLANDS} SELECT cluster, n FROM i ORDER BY n DESC, cluster LIMIT 3", "tracks")
def w9(spark, sf):
    return aggregates.islands(plotted(spark, sf)).orderBy(F.desc("n"), "cluster").limit(3).select("cluster", "n")


@query("w10_star_magnitudes", f"""
WITH s AS (SELECT *, {ENERGY_SQL} AS energy, avg(x) OVER (PARTITION BY cluster) AS cx, avg(y) OVER (PARTITION BY cluster) AS cy FROM tracks), d AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM s)
SELECT track_id, round(greatest(0.05, least(CAST(1 AS DOUBLE), CAST(0.07 AS DOUBLE) + CAST(0.5 AS DOUBLE) * pow(1 - d / greatest(max(d) OVER (PARTITION BY cluster), 0.001), CAST(1.2 AS DOUBLE)) + CAST(0.31 AS DOUBLE) * CASE WHEN energy_rating IS NOT NULL THEN energy_rating / CAST(10 AS DOUBLE) ELSE 0.46 END + CAST(0.12 AS DOUBLE) * {fnv_sql('track_id')} / CAST(4294967296 AS DOUBLE))), 5) AS magnitude FROM d""", "tracks")
def w10(spark, sf):
    t = view(spark, sf, "tracks").withColumn("energy", S.energy(C("energy_rating"))).withColumn("energy_score", C("energy_rating").cast("double"))
    return aggregates.star_magnitudes(t).select("track_id", F.round("magnitude", 5).alias("magnitude"))


@query("w11_default_order", "SELECT track_id, row_number() OVER (ORDER BY cluster, title, track_id)::INT AS position FROM tracks WHERE cluster = 4", "tracks")
def w11(spark, sf):
    t = filters.rankable(studio(spark, sf)).where("cluster = 4")
    return t.withColumn("position", F.row_number().over(Window.partitionBy("cluster").orderBy("title", "track_id"))).select("track_id", "position")


@query("w12_top_labels", """
WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, 'l' || lpad(CAST(unnest(range(len(embedding))) AS VARCHAR), 2, '0') AS l FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, l) AS n FROM s)
SELECT vec_id AS track_id, string_agg(l, ', ' ORDER BY n) FILTER (n <= 3) AS text, max(l) FILTER (n = 1) AS label, round(max(v), 4) AS confidence, count(*) FILTER (n <= 6) AS n FROM r GROUP BY vec_id""")
def w12(spark, sf):
    e = view(spark, sf, "embeddings").select(C("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("l"), F.lpad(i.cast("string"), 2, "0"))).alias("labels"))
    return ranking.top_labels(e).select("track_id", "text", "label", "confidence", F.size("top").cast("long").alias("n"))


@query("w13_library_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'BUILDING', c_custkey)::INT AS position FROM customer")
def w13(spark, sf):
    order = Window.partitionBy("c_nationkey").orderBy(C("c_mktsegment") != "BUILDING", "c_custkey")
    return view(spark, sf, "customer").select("c_custkey", F.row_number().over(order).alias("position"))


@query("w14_similar_panel", "SELECT track_id, position FROM (SELECT track_id, row_number() OVER (PARTITION BY cluster ORDER BY title, track_id)::INT AS position FROM tracks) WHERE position <= 6", "tracks")
def w14(spark, sf):
    return ranking.top_k(view(spark, sf, "tracks").select("track_id", "cluster", "title"), ["cluster"], ["title", "track_id"], 6, "position").select("track_id", "position")


@query("v1_contracts", """
SELECT CAST(stage_id AS VARCHAR) AS key, 'status' AS rule FROM stages WHERE status = 'running' UNION ALL SELECT CAST(stage_id AS VARCHAR), 'attempts' FROM stages WHERE attempt_count > 2 UNION ALL SELECT CAST(stage_id AS VARCHAR), 'cache_key' FROM stages WHERE cache_key IS NULL""", "stages")
def v1(spark, sf):
    return validate.violations(view(spark, sf, "stages"), "stage_id", {"status": C("status").isin("queued", "succeeded", "failed", "skipped"), "attempts": C("attempt_count").between(1, 2), "cache_key": C("cache_key").rlike("^k[0-9]+$")})


@query("v2_corpus_check", "SELECT count(*) AS tracks, true AS one_each, true AS one_dim, false AS one_model, true AS finite, true AS not_zero FROM tracks", "tracks")
def v2(spark, sf):
    return validate.corpus_check(view(spark, sf, "tracks").select("track_id", "embedding", C("library_id").alias("model")))


@query("v3_incomplete_rankings", f"WITH {RESULTS} SELECT configuration_id, anchor_track_id, CASE WHEN anchor_track_id = 't000002' THEN 'wrong count' ELSE 'ranks not contiguous' END AS reason FROM results WHERE rank = 1 AND anchor_track_id IN ('t000002', 't000003')", "tracks")
def v3(spark, sf):
    r = results(spark, sf).where("rank <= 20")
    pools = results(spark, sf).select("anchor_track_id", "candidate_track_id").distinct()
    r = r.where("NOT (anchor_track_id = 't000002' AND rank = 20)").withColumn("rank", F.when((C("anchor_track_id") == "t000003") & (C("rank") == 20), 21).otherwise(C("rank")))
    return evaluation.incomplete_rankings(r, pools, 20)


@query("v4_set_integrity", "SELECT library_id AS set_id, 'anchor' AS kind, track_id FROM tracks WHERE cluster = 1 AND track_id > 't000100' UNION ALL SELECT library_id, 'pool', concat(track_id, 'x') FROM tracks WHERE cluster = 1", "tracks")
def v4(spark, sf):
    t = view(spark, sf, "tracks")
    anchors = t.where("cluster = 1").select(C("library_id").alias("set_id"), C("track_id").alias("anchor_track_id"), F.array(F.lit("t000001"), F.concat("track_id", F.lit("x"))).alias("pool"))
    corpus = t.where("cluster <> 1 OR track_id <= 't000100'").select(C("library_id").alias("set_id"), "track_id").union(t.select("library_id", F.lit("t000001")).distinct())
    return validate.set_integrity(anchors, corpus)


@query("v5_judgment_integrity", f"""
WITH {RESULTS}, j AS (SELECT *, concat('t', lpad(CAST(judgment_id % 97 AS VARCHAR), 6, '0')) AS candidate, judgment_id // 2 AS idem FROM judgments), k AS (SELECT idem, count(DISTINCT (configuration_id, anchor_track_id, candidate, judgment, evaluator_id)) > 1 AS clash FROM j GROUP BY idem)
SELECT judgment_id, CASE WHEN CAST(substr(evaluator_id, 2) AS INT) % 10 = 0 THEN 'not a member' WHEN r.rank IS NULL THEN 'not in ranking' WHEN judgment_id % 4 = 0 AND rank_position <> r.rank THEN 'rank differs' WHEN clash THEN 'key reused' END AS reason, CASE WHEN judgment_id % 4 = 0 THEN rank_position ELSE r.rank END::INT AS rank_position
FROM j JOIN k USING (idem) LEFT JOIN results r ON j.configuration_id = r.configuration_id AND j.anchor_track_id = r.anchor_track_id AND j.candidate = r.candidate_track_id""", "tracks judgments")
def v5(spark, sf):
    j = view(spark, sf, "judgments").withColumns({"candidate_track_id": F.expr("concat('t', lpad(CAST(judgment_id % 97 AS STRING), 6, '0'))"), "idempotency_key": F.expr("judgment_id DIV 2"), "rank_position": F.expr("CASE WHEN judgment_id % 4 = 0 THEN rank_position END")})
    members = j.select("evaluator_id").distinct().where("CAST(substr(evaluator_id, 2) AS INT) % 10 <> 0")
    return evaluation.judgment_conflicts(j, results(spark, sf), members)


@query("v6_manifest_conflicts", "SELECT l_partkey AS name, l_linenumber AS version, count(DISTINCT l_suppkey) AS hashes FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def v6(spark, sf):
    return validate.manifest_conflicts(view(spark, sf, "lineitem").select(C("l_partkey").alias("name"), C("l_linenumber").alias("version"), C("l_suppkey").alias("manifest_hash")))


@query("v7_identity_mismatches", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'model' ELSE 'source changed' END AS reason FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def v7(spark, sf):
    runs = view(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "'m1' AS model", "'h' AS content_hash")
    now = view(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'm2' ELSE 'm1' END AS resolved_model", "CASE WHEN o_orderkey % 7 = 0 THEN 'i' ELSE 'h' END AS resolved_hash")
    return validate.identity_mismatches(runs, now)
