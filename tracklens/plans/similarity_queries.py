"""Similarity, maps, recommendations, windows (K*, T*, E*, X*, N*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.operators import evaluation, evidence, filters, layout, projection, recommend, similarity, spectral
from tracklens.operators.neighbour_store import NeighbourStore
from tracklens.operators.vector_index import VectorIndex
from tracklens.plans.adapters import view
from tracklens.plans.base import query
from tracklens.plans.aggregate_queries import METRICS, metrics
from tracklens.plans.join_queries import RESULTS, STUDIO, TRIPLETS, results, studio
from tracklens.plans.scalar_queries import NEIGHBOURS, fnv_sql
from tracklens.sources.shared import shared_path

C = F.col
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]))"
UNITS = """d AS (SELECT track_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM tracks), s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM d GROUP BY pos),
z AS (SELECT track_id, list((v - m) / sd ORDER BY pos) AS z FROM d JOIN s USING (pos) GROUP BY track_id),
u AS (SELECT track_id, list_transform(z, lambda x: x / sqrt(list_sum(list_transform(z, lambda w: w * w)))) AS u FROM z)"""
KNN = f"""{UNITS}, p AS (SELECT a.track_id AS source, b.track_id AS target, greatest(-1, least(1, {DOT.format(a='a.u', b='b.u')})) AS score FROM u a JOIN u b ON a.track_id <> b.track_id),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target)::INT AS rank FROM p)"""


def vectors(spark, sf):
    return view(spark, sf, "tracks").select("track_id", F.lit("m").alias("model"), "embedding")


def neighbours(spark, sf, k=10):
    return similarity.knn(vectors(spark, sf), k)


@query("k1_exact_knn", f"WITH {KNN} SELECT source, target, rank, round(score, 6) AS score, round(1 - score, 6) AS distance FROM k WHERE rank <= 10", "tracks")
def k1(spark, sf):
    return neighbours(spark, sf).select("source", "target", "rank", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


FROZEN = KNN.replace("FROM d GROUP BY pos", "FROM d JOIN tracks t USING (track_id) WHERE t.cluster <> 3 GROUP BY pos")


@query("k1_kept_neighbours", f"WITH {FROZEN} SELECT source, target, rank, round(score, 6) AS score FROM k WHERE rank <= 10", "tracks")
def k1_kept(spark, sf):
    """A store built without a cluster, and with vectors that change later, then brought to what all tracks are now."""
    t = view(spark, sf, "tracks").select("track_id", "cluster", "embedding")
    first = t.where("cluster <> 3")
    store = NeighbourStore.build(first.select("track_id", "embedding"), shared_path(spark, "kept"), 10)
    turned = F.when(C("cluster") == 4, F.reverse("embedding")).otherwise(C("embedding")).alias("embedding")
    store.update(first.where("cluster <> 5").select("track_id", turned))
    store.update(t.select("track_id", "embedding"))
    return store.lists().select("source", "target", "rank", F.round("score", 6).alias("score"))


@query("j4_pairwise_cosine", f"WITH {KNN} SELECT source, count(*) AS pairs, round(max(score), 6) AS best FROM k GROUP BY source", "tracks")
def j4(spark, sf):
    units = similarity.unit_vectors(vectors(spark, sf), True)
    return similarity.pair_similarities(units).select("source", "pairs", F.round("best", 6).alias("best"))


@query("k2_seed_ranking", f"WITH {KNN} SELECT target AS track_id, round(score, 6) AS score FROM k WHERE source = 't000007' AND rank <= 25", "tracks")
def k2(spark, sf):
    return similarity.rank_for_seed(vectors(spark, sf), "t000007", 25).select("track_id", F.round("score", 6).alias("score"))


@query("k3_corpus", "SELECT track_id, 2 AS created_at FROM tracks WHERE library_id = 'L2' AND cluster <> 3 UNION ALL SELECT track_id, 1 FROM tracks WHERE library_id = 'L2' AND cluster = 3", "tracks")
def k3(spark, sf):
    t = view(spark, sf, "tracks")
    old = t.select("track_id", F.lit("m").alias("model"), "embedding", F.lit(1).alias("created_at"))
    new = t.select("track_id", F.lit("m").alias("model"), F.when(C("cluster") == 3, F.transform("embedding", lambda x: x * float("inf"))).otherwise(C("embedding")).alias("embedding"), F.lit(2).alias("created_at"))
    return similarity.corpus(old.union(new), t, "m", "L2").select("track_id", "created_at")


@query("k4_approximate_knn")
def k4(spark, sf):
    return similarity.approximate_pairs(vectors(spark, sf), 10)


@query("k4_indexed_knn")
def k4_index(spark, sf):
    """An index built on all tracks and asked for each of them."""
    v = vectors(spark, sf).select("track_id", "embedding")
    return VectorIndex.build(v, shared_path(spark, "index")).search(v, 10)


@query("k5_reduced_vectors")
def k5(spark, sf):
    return projection.reduce_vectors(vectors(spark, sf).select("track_id", "embedding"), 16)


@query("k6_standard_map")
def k6(spark, sf):
    return projection.standard_map(vectors(spark, sf).select("track_id", "embedding"))


@query("k6_neighbour_map")
def k6_neighbours(spark, sf):
    return layout.neighbour_map(vectors(spark, sf))


@query("k7_pca_map")
def k7(spark, sf):
    return projection.pca_map(vectors(spark, sf).select("track_id", "embedding"))


@query("k8_clusters")
def k8(spark, sf):
    v = vectors(spark, sf).select("track_id", "embedding")
    return projection.cluster_labels(projection.cluster_space(v), v.count())


@query("k8_merged_clusters")
def k8_merged(spark, sf):
    v = vectors(spark, sf).select("track_id", "embedding")
    return projection.merged_labels(projection.cluster_space(v), v.count())


@query("k9_assignments")
def k9(spark, sf):
    t = view(spark, sf, "tracks").select("track_id", "bpm", "energy_rating", (C("created_at") / 1000).alias("valence"), "genre", "embedding")
    features = t.where("genre <> ''").select("track_id", F.concat(F.lit("genre::"), "genre").alias("feature_key"), F.lit(1.0).alias("value"))
    return projection.assign_tracks(t.drop("genre", "embedding"), t.select("track_id", "embedding"), features)


@query("k10_genre_islands", f"""
WITH p AS (SELECT *, CASE WHEN genre LIKE 'Nu%' THEN 'Nu Disco' WHEN genre = '' THEN 'Unlabeled' ELSE genre END AS name FROM tracks), g AS (SELECT library_id, avg(x) AS gx, avg(y) AS gy FROM p GROUP BY library_id), c AS (SELECT library_id, lower(name) AS key, name, count(*) AS mass, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY ALL),
r AS (SELECT p.library_id, lower(p.name) AS key, greatest(0.55, quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 0.9) * 1.08) AS radius FROM p JOIN c ON p.library_id = c.library_id AND p.name = c.name GROUP BY ALL)
SELECT c.library_id, c.key, mass, round(radius, 6) AS radius, round((cx - gx) * 2.8 + cos({fnv_sql('c.key')} / CAST(4294967296 AS DOUBLE) * 2 * pi()) * 0.45, 6) AS x, (row_number() OVER (PARTITION BY c.library_id ORDER BY c.key) - 1)::INT AS cluster FROM c JOIN g USING (library_id) JOIN r ON r.library_id = c.library_id AND r.key = c.key""", "tracks")
def k10(spark, sf):
    i, _ = projection.genre_islands(view(spark, sf, "tracks").select("library_id", "track_id", "genre", "x", "y"))
    return i.select("library_id", "key", "mass", F.round("radius", 6).alias("radius"), F.round("x", 6).alias("x"), "cluster")


@query("k11_packed_islands")
def k11(spark, sf):
    i, _ = projection.genre_islands(view(spark, sf, "tracks").select("library_id", "track_id", "genre", "x", "y"))
    return projection.pack_islands(i)


@query("k12_genre_projection")
def k12(spark, sf):
    """A run has most tracks; vectors have some of the others."""
    t = view(spark, sf, "tracks")
    members = t.where("cluster < 8").select(F.lit("r1").alias("run_id"), "track_id", "x", "y").union(t.where("cluster < 2").select(F.lit("r2"), "track_id", "y", "x"))
    return projection.island_projection(t.select("track_id", "library_id", "genre"), members, t.where("cluster < 9").select("track_id", "embedding"))


@query("k13_neighbourhoods", """
WITH c AS (SELECT cluster AS c, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM tracks WHERE cluster > 0 GROUP BY cluster), p AS (SELECT track_id, CASE WHEN cluster = 0 THEN -1 ELSE cluster END AS cluster, x, y FROM tracks)
SELECT track_id, CASE WHEN any_value(cluster) < 0 THEN 'Outliers / one-offs' ELSE concat('Cluster ', any_value(cluster)) END AS home, coalesce(max(n) FILTER (c = cluster), 0) AS shared, concat('Cluster ', arg_min(c, (sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), c)) FILTER (c <> cluster)) AS lean FROM p, c GROUP BY track_id""", "tracks")
def k13(spark, sf):
    t = view(spark, sf, "tracks")
    return projection.neighbourhoods(filters.plot_rows(t.withColumn("cluster_id", F.when(C("cluster") > 0, C("cluster").cast("string"))).drop("cluster")))


@query("k14_map_neighbours", """
SELECT track_id, score FROM (SELECT t.track_id, greatest(0, floor((1 - least(1, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) / 4.8)) * 100 + 0.5) / 100) AS score FROM tracks t, (SELECT * FROM tracks WHERE track_id = 't000005') s WHERE t.track_id <> 't000005' AND t.cluster <> 2) ORDER BY score DESC, track_id LIMIT 24""", "tracks")
def k14(spark, sf):
    t = view(spark, sf, "tracks").withColumn("analysis_status", F.when(C("cluster") == 2, "failed").otherwise("ok"))
    return similarity.map_neighbours(t, "t000005")


@query("k15_prompt_scores", f"""
WITH n AS (SELECT track_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)))) AS u FROM tracks), s AS (SELECT a.track_id, b.track_id AS prompt, {DOT.format(a='a.u', b='b.u')} AS score FROM n a JOIN n b ON b.track_id < 't000008'),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, prompt) AS n FROM s)
SELECT track_id, string_agg('vibe::' || prompt, ',' ORDER BY prompt) FILTER (n <= 6) AS top, round(sum(round(score, 4)) FILTER (n <= 6), 4) AS top_sum, string_agg(prompt, ' / ' ORDER BY n) FILTER (n <= 3) AS mood_top, arg_min(prompt, n) AS genre_pred,
 round(avg(score) FILTER (prompt IN ('t000001', 't000002')), 5) AS energy_rms, round(avg(score) FILTER (prompt IN ('t000003', 't000004', 't000005')), 5) AS engagement FROM r GROUP BY track_id""", "tracks")
def k15(spark, sf):
    t = view(spark, sf, "tracks")
    bank = t.where("track_id < 't000008'").select(C("track_id").alias("prompt"), "embedding")
    f = similarity.prompt_features(similarity.prompt_scores(t, bank), ["t000001", "t000002"], ["t000003", "t000004", "t000005"])
    total = F.aggregate(F.map_values("top"), F.lit(0.0), lambda a, x: a + x)
    return f.select("track_id", F.concat_ws(",", F.array_sort(F.map_keys("top"))).alias("top"), F.round(total, 4).alias("top_sum"), "mood_top", "genre_pred", "energy_rms", "engagement")


@query("k16_head_scores", """
WITH s AS (SELECT l_partkey AS track_id, l_returnflag AS head, CAST(l_quantity AS INT) % 9 AS label, avg(l_extendedprice::DOUBLE / 100000) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY track_id, head ORDER BY score DESC, label) AS n FROM s)
SELECT track_id, count(*) FILTER (head IN ('A', 'N') AND n <= 6) AS top, round(sum(format('{:.4f}', score)::DOUBLE) FILTER (head IN ('A', 'N') AND n <= 6), 4) AS top_sum, max(label::VARCHAR) FILTER (head = 'N' AND n = 1) AS best, max(format('{:.4f}', score)::DOUBLE) FILTER (head = 'R' AND label = 4) AS picked FROM r GROUP BY track_id""")
def k16(spark, sf):
    f = view(spark, sf, "lineitem").select(C("l_partkey").alias("track_id"), C("l_returnflag").alias("head"), (C("l_quantity").cast("int") % 9).cast("string").alias("label"), (C("l_extendedprice").cast("double") / 100000).alias("value"))
    out = similarity.head_features(similarity.head_scores(f), ["A", "N"], {"R": "4"})
    total = F.aggregate(F.map_values("top"), F.lit(0.0), lambda a, x: a + x)
    return out.select("track_id", F.size("top").cast("long").alias("top"), F.when(F.size("top") > 0, F.round(total, 4)).alias("top_sum"), C("best")["N"].alias("best"), C("picks")["R"].alias("picked"))


@query("t1_candidates", """
SELECT track_id, points::DOUBLE AS points FROM (SELECT track_id, title, CASE WHEN cluster = 1 THEN 3 ELSE 0 END + CASE WHEN cluster = 2 THEN 2 ELSE 0 END + coalesce(CASE WHEN abs(bpm - 122) <= 4 THEN 8 WHEN abs(bpm - 122) <= 8 THEN 4 WHEN abs(bpm - 122) <= 12 THEN 1 END, 0) AS points FROM tracks WHERE cluster <> 4 AND track_id <> 't000003') ORDER BY points DESC, lower(title), title, track_id LIMIT 48""", "tracks")
def t1(spark, sf):
    t = view(spark, sf, "tracks").withColumn("analysis_status", F.when(C("cluster") == 4, "failed").otherwise("ok")).withColumn("hidden", F.lit(False))
    return recommend.pick_candidates(t, "around 122 BPM", t.where("cluster = 1"), t.where("cluster = 2"), "t000003").select("track_id", C("points").cast("double").alias("points"))


CANDIDATES = f"""{STUDIO}, r AS (SELECT 'q' || (row_number() OVER (ORDER BY p)) AS request_id, p AS prompt FROM (SELECT unnest(['darker low around 121', 'lift the peak', 'warm sunset 118 bpm']) AS p)),
cand AS (SELECT request_id, prompt, st.*, (created_at % 100) / CAST(100 AS DOUBLE) AS score, CASE WHEN len(tx) = 0 THEN ['minimal'] ELSE tx END AS textures FROM r, (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(genre), '{p}') THEN '{v}' END" for p, v in S.TEXTURE_RULES)}], lambda x: x IS NOT NULL) AS tx FROM st) st),
scored AS (SELECT *, round(score + 0.08 * (len(list_filter(list_concat([mood, energy, genre], textures), lambda w: contains(prompt, lower(w))))) + CASE WHEN regexp_matches(prompt, 'dark|darker|afterhours|late|warehouse') AND mood = 'dark' THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(prompt, 'warm|sunset|warm[ -]?up|opening|lounge') AND mood = 'warm' THEN 0.12 ELSE 0 END
 + CASE WHEN regexp_matches(prompt, 'low|lower|down|gentle') AND energy = 'low' THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(prompt, 'lift|peak|up|driving') AND energy IN ('peak', 'driving') THEN 0.1 ELSE 0 END
 + coalesce(CASE WHEN abs(bpm - c) <= 4 THEN 0.16 WHEN abs(bpm - c) <= 8 THEN 0.08 END, 0), 6) AS k FROM (SELECT *, CASE WHEN prompt LIKE '%121' THEN 121 WHEN prompt LIKE '%118 bpm' THEN 118 END AS c FROM cand))"""


def candidates(spark, sf):
    t = studio(spark, sf).select("track_id", "mood", "energy", F.coalesce("genre", F.lit("")).alias("genre"), "textures", "bpm", "musical_key", ((C("created_at") % 100) / 100).alias("score"))
    prompts = F.array(*[F.struct(F.lit(f"q{i}").alias("request_id"), F.lit(p).alias("prompt")) for i, p in ((1, "darker low around 121"), (2, "lift the peak"), (3, "warm sunset 118 bpm"))])
    return t.select("*", F.inline(prompts))


@query("t2_keyword_scores", f"WITH {CANDIDATES} SELECT request_id, track_id, k AS score FROM scored", "tracks")
def t2(spark, sf):
    return candidates(spark, sf).select("request_id", "track_id", F.round(recommend.keyword_score(C("prompt")), 6).alias("score"))


@query("t3_recommendations", f"""
WITH {CANDIDATES}, n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY k DESC, track_id)::INT AS position FROM scored)
SELECT request_id, position, track_id, concat(floor(score * 100 + 0.5)::INT, '% nearby · ', mood, ' mood · ', energy, ' energy · ', textures[1], ' texture') AS reason, CASE WHEN position <= 3 OR score >= 0.85 THEN 'safer' ELSE 'pivot' END AS blend FROM n WHERE position <= 6""", "tracks")
def t3(spark, sf):
    return recommend.recommend(candidates(spark, sf))


@query("t4_seed_cards", f"WITH {KNN}, c AS (SELECT source, target AS track_id, row_number() OVER (PARTITION BY source ORDER BY rank)::INT AS position FROM k JOIN tracks t ON t.track_id = k.target WHERE rank <= 10 AND t.bpm >= 115) SELECT * FROM c WHERE position <= 8", "tracks")
def t4(spark, sf):
    n = neighbours(spark, sf).withColumnRenamed("target", "track_id")
    return recommend.seed_cards(n, studio(spark, sf), filters.map_predicate(bpm_min=115))


def audio(spark, sf):
    return view(spark, sf, "tracks").select("track_id", (C("duration_sec") * 1000).cast("long").alias("frames"), F.lit(1000).alias("rate"))


@query("e1_windows", """
WITH a AS (SELECT track_id, (duration_sec * 1000)::BIGINT AS n FROM tracks), c AS (SELECT *, floor(n * 0.15)::BIGINT AS s FROM a),
o AS (SELECT track_id, unnest(list_distinct(list_append(range(0, n - 10000 + 1, 5000), n - 10000))) AS start, 10000 AS size, 'full-overlap-v1' AS version FROM a
 UNION ALL SELECT track_id, unnest([0, (n - 10000) // 2, n - 10000]), 10000, 'sampled-v1' FROM a
 UNION ALL SELECT track_id, s + greatest(0, n - 2 * s - 120000) // 2, least(n - 2 * s, 120000), 'legacy-librosa-v1' FROM c
 UNION ALL SELECT track_id, s + greatest(0, n - 2 * s - 90000) // 2, least(n - 2 * s, 90000), 'legacy-essentia-v1' FROM c
 UNION ALL SELECT track_id, s + greatest(0, n - 2 * s - 120000) // 2 + unnest([0, (least(n - 2 * s, 120000) - 10000) // 2, least(n - 2 * s, 120000) - 10000]), 10000, 'legacy-clap-v1' FROM c)
SELECT track_id, version, (row_number() OVER (PARTITION BY track_id, version ORDER BY start) - 1)::INT AS "index", start::BIGINT AS start, (start + size)::BIGINT AS "end", start::BIGINT AS start_ms, (start + size)::BIGINT AS end_ms FROM o""", "tracks")
def e1(spark, sf):
    return evidence.expand_windows(audio(spark, sf), spark.createDataFrame(evidence.PLANS, evidence.PLAN))


@query("e2_plan_errors", "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS version, CASE WHEN l_linenumber = 1 THEN 'even takes window and count' WHEN l_linenumber = 2 THEN 'must be positive' ELSE 'unknown strategy' END AS error FROM lineitem WHERE l_linenumber <= 3")
def e2(spark, sf):
    p = view(spark, sf, "lineitem").selectExpr("CAST(l_orderkey * 10 + l_linenumber AS STRING) AS version", "CASE l_linenumber WHEN 1 THEN 'even' WHEN 3 THEN 'odd' ELSE 'overlap' END AS strategy", "CASE WHEN l_linenumber = 2 THEN -1.0D ELSE 10.0D END AS window_sec", "5.0D AS hop_sec", "CAST(NULL AS INT) AS count", "0.1D AS edge_skip", "20.0D AS minimum_core_sec", "CAST(NULL AS DOUBLE) AS max_core_sec")
    return evidence.plan_errors(p)


@query("e3_run_stages", """
SELECT sha256(concat('r1|', track_id, '|', name, '|1')) AS stage_id, track_id, name, name = 'librosa' AS required, sha256(concat(location, '|', name, '|1|sampled-v1')) AS cache_key FROM tracks, (SELECT unnest(['librosa', 'clap']) AS name)""", "tracks")
def e3(spark, sf):
    m = spark.createDataFrame([("clap", "1", False, "sampled-v1", 0), ("librosa", "1", False, "sampled-v1", 1), ("librosa", "1", True, "sampled-v1", 2)], "name string, extractor_version string, required boolean, plan string, position int")
    return evidence.expand_run("r1", view(spark, sf, "tracks").withColumn("content_hash", C("location")), m).select("stage_id", "track_id", "name", "required", "cache_key")


def _samples(spark, sf):
    """Vectors taken as windows of samples; some aren't finite, so that their extraction fails."""
    return view(spark, sf, "tracks").select("track_id", F.when(C("cluster") == 3, F.array(F.lit(float("nan")))).otherwise(F.transform("embedding", lambda x: x.cast("double"))).alias("samples"), F.lit(8000).alias("rate"))


@query("e4_extraction", "SELECT track_id, CASE WHEN cluster = 3 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN cluster = 3 THEN 2 ELSE 1 END AS attempts FROM tracks", "tracks")
def e4(spark, sf):
    return evidence.extract(_samples(spark, sf), [("signal", "1", evidence.signal_features)], "track_id").select("track_id", "status", "attempts")


@query("e5_signal_features", "SELECT track_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64), 6) AS rms, CAST(0.008 AS DOUBLE) AS duration_sec FROM tracks WHERE cluster <> 3", "tracks")
def e5(spark, sf):
    out = evidence.extract(_samples(spark, sf), [("signal", "1", evidence.signal_features)], "track_id").where("status = 'ok'")
    return out.select("track_id", C("features")["rms"].alias("rms"), C("features")["duration_sec"].alias("duration_sec"))


@query("e5_spectral_features")
def e5_spectral(spark, sf):
    """Each track as eight seconds of clicks at its tempo."""
    t, rate, n = view(spark, sf, "tracks").select("track_id", "bpm"), 2000, 16_000
    beat = F.coalesce(C("bpm"), F.lit(120.0)) / 60 / rate
    sound = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i * beat - F.floor(i * beat) < 0.02, F.sin(i * 1.7)).otherwise(0.0))
    out = spectral.describe(t.repartition(32).select("track_id", sound.alias("samples"), F.lit(rate).alias("rate")), "track_id")
    return out.select("track_id", C("features")["est_bpm"].alias("est_bpm"), C("features")["onset_density_per_sec"].alias("onset_density_per_sec"), F.size("embedding").alias("dimensions"))


@query("x1_extractor_registry", "SELECT track_id, 'count' AS extractor, '2' AS version, CAST(64 AS DOUBLE) AS n FROM tracks WHERE cluster <> 3", "tracks")
def x1(spark, sf):
    registry = evidence.ExtractorRegistry()
    registry.register("count", "2", lambda row: {"n": len(row["samples"])})
    run, _ = registry.plan([("count", None, True), ("absent", None, False)])
    out = evidence.extract(_samples(spark, sf), run, "track_id")
    return out.where("features['n'] > 1").select("track_id", "extractor", "version", C("features")["n"].alias("n"))


@query("n1_late_fusion", f"WITH {RESULTS} SELECT anchor_track_id, candidate_track_id, round(sum(w / rank) / sum(w), 6) AS score FROM (SELECT *, CASE configuration_id WHEN 'c1' THEN 0.7 ELSE 0.3 END::DOUBLE AS w FROM results WHERE configuration_id = 'c1' OR rank % 3 > 0) GROUP BY ALL", "tracks")
def n1(spark, sf):
    """A channel lacks every third of its candidates."""
    scores = results(spark, sf).where("configuration_id = 'c1' OR rank % 3 > 0").select(C("anchor_track_id").alias("source"), C("candidate_track_id").alias("target"), C("configuration_id").alias("channel"), (1 / C("rank")).alias("score"))
    return similarity.late_fusion(scores, {"c1": 0.7, "c2": 0.3}).select(C("source").alias("anchor_track_id"), C("target").alias("candidate_track_id"), F.round("score", 6).alias("score"))


@query("n2_mix_compatibility", f"""
WITH p AS (SELECT track_id, exp(-pow((bpm - 122) / CAST(4 AS DOUBLE), 2) / 2) AS b, CASE WHEN musical_key = '' THEN NULL WHEN musical_key = '8A' OR list_contains(string_split({NEIGHBOURS.format(k='musical_key')}, ','), '8A') THEN 1.0 ELSE 0.0 END::DOUBLE AS k, 1 - abs(energy_rating - 6) / CAST(9 AS DOUBLE) AS e FROM tracks)
SELECT track_id, round((coalesce(b * 0.4::DOUBLE, 0) + coalesce(k * 0.4::DOUBLE, 0) + coalesce(e * 0.2::DOUBLE, 0)) / nullif(CASE WHEN b IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN k IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN e IS NULL THEN 0 ELSE 0.2::DOUBLE END, 0), 6) AS score FROM p""", "tracks")
def n2(spark, sf):
    score = similarity.mix_compatibility(C("bpm"), C("musical_key"), C("energy_rating").cast("double"), F.lit(122.0), F.lit("8A"), F.lit(6.0))
    return view(spark, sf, "tracks").select("track_id", F.round(score, 6).alias("score"))


@query("n3_frozen_projection")
def n3(spark, sf):
    """A projection fitted on one library and saved; coordinates of the other's tracks."""
    t, path = view(spark, sf, "tracks"), shared_path(spark, "projection")
    projection.save_projection(t.where("library_id = 'L1'").select("track_id", "embedding"), path)
    return projection.project_frozen(t.where("library_id = 'L2'").select("track_id", "embedding"), path).select("track_id", "x", "y")


@query("n4_promotions", f"""
WITH {RESULTS}, {TRIPLETS}, {METRICS}, b AS (SELECT metric_name, dimension, value AS base FROM metrics WHERE configuration_id = 'c1')
SELECT configuration_id, coalesce(bool_or(dimension = 'overall' AND ((metric_name = 'ndcg_at_10' AND value >= 1.1 * base) OR (metric_name = 'triplet_accuracy' AND value >= base + 0.05))), false) AND NOT coalesce(bool_or(value < base - 0.1), false) AS promoted FROM metrics JOIN b USING (metric_name, dimension) WHERE configuration_id <> 'c1' GROUP BY configuration_id""", "tracks judgments")
def n4(spark, sf):
    return evaluation.promotions(metrics(spark, sf), "c1")


@query("n5_tag_divergence", """
WITH c AS (SELECT l_partkey, [sum(l_quantity)::DOUBLE, sum(l_linenumber)::DOUBLE, count(*)::DOUBLE] AS p, [1.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE] AS q FROM lineitem GROUP BY l_partkey), s AS (SELECT l_partkey, list_transform(p, lambda x: x / list_sum(p)) AS p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM c)
SELECT l_partkey, round((list_sum(list_transform(list_zip(p, q), lambda t: CASE WHEN t[1] > 0 THEN t[1] * log2(t[1] / ((t[1] + t[2]) / 2)) ELSE 0 END)) + list_sum(list_transform(list_zip(p, q), lambda t: CASE WHEN t[2] > 0 THEN t[2] * log2(t[2] / ((t[1] + t[2]) / 2)) ELSE 0 END))) / 2, 6) AS divergence FROM s""")
def n5(spark, sf):
    c = view(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array(F.sum("l_quantity").cast("double"), F.sum("l_linenumber").cast("double"), F.count("*").cast("double")).alias("p"))
    return c.withColumn("q", F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0))).select("l_partkey", F.round(similarity.divergence("p", "q"), 6).alias("divergence"))


def flagship(spark, sf):
    """Each track's nearest tracks that pass the studio filter."""
    f = filters.StudioFilter(moods=["warm", "hypnotic", "euphoric"])
    n = neighbours(spark, sf).withColumnRenamed("target", "track_id")
    return n.join(filters.rankable(studio(spark, sf)).where(filters.studio_predicate(f)).select("track_id", "title"), "track_id").select("source", "track_id", "title", "rank", F.round("score", 6).alias("score"))
