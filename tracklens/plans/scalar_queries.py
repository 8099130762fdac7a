"""Projections over the catalogue (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.plans.adapters import view
from tracklens.plans.base import query

C = F.col


@query("p1_filename_parts", r"""
WITH f AS (SELECT track_id, CASE WHEN track_id < 't000100' THEN concat('/lib/', title, ' - ', genre, '.mp3') WHEN track_id < 't000200' THEN concat('/lib/', artist, '/Album/', title, '.wav') ELSE concat('/lib', location) END AS path FROM tracks),
s AS (SELECT *, trim(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1')) AS stem, string_split(substr(path, 6), '/') AS below FROM f)
SELECT track_id,
  CASE WHEN stem LIKE '%_ - _%' THEN trim(string_split(stem, ' - ')[1]) WHEN len(below) >= 3 AND below[-3] <> '' AND lower(below[-3]) NOT IN ('contents', 'music', 'unknown artist') THEN below[-3] ELSE '' END AS artist,
  CASE WHEN stem LIKE '%_ - _%' THEN trim(string_split(stem, ' - ')[2]) ELSE stem END AS title
FROM s""", "tracks")
def p1(spark, sf):
    t = view(spark, sf, "tracks")
    path = F.when(C("track_id") < "t000100", F.concat(F.lit("/lib/"), "title", F.lit(" - "), "genre", F.lit(".mp3"))).when(C("track_id") < "t000200", F.concat(F.lit("/lib/"), "artist", F.lit("/Album/"), "title", F.lit(".wav"))).otherwise(F.concat(F.lit("/lib"), "location"))
    parts = S.filename_parts(C("path"), F.lit("/lib"))
    return t.withColumn("path", path).select("track_id", parts["artist"].alias("artist"), parts["title"].alias("title"))


@query("p2_location_kind", """
SELECT track_id, CASE WHEN track_id < 't000050' THEN 'pseudo' WHEN track_id < 't000060' THEN 'empty' ELSE 'file' END AS kind FROM tracks""", "tracks")
def p2(spark, sf):
    place = F.when(C("track_id") < "t000050", F.concat(F.lit(" Spotify:track:"), "track_id")).when(C("track_id") < "t000060", F.lit("  ")).otherwise(C("location"))
    return view(spark, sf, "tracks").select("track_id", S.location_kind(place).alias("kind"))


@query("p3_identity", r"SELECT o_orderkey, lower(regexp_replace(o_orderpriority || ' ' || o_orderstatus, '[^A-Za-z0-9]', '', 'g')) AS identity FROM orders")
def p3(spark, sf):
    return view(spark, sf, "orders").select("o_orderkey", S.identity_part(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("identity"))


KEYS = "CASE WHEN track_id < 't000100' THEN concat('0', musical_key, ' ') WHEN track_id < 't000150' THEN lower(musical_key) WHEN track_id < 't000160' THEN 'C minor' ELSE musical_key END"


@query("p4_canonical_key", f"SELECT track_id, CASE WHEN track_id BETWEEN 't000150' AND 't000159' THEN 'CMINOR' WHEN track_id < 't000100' AND musical_key = '' THEN '0' ELSE musical_key END AS k FROM (SELECT * FROM tracks)", "tracks")
def p4(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.canonical_key(F.expr(KEYS)).alias("k"))


@query("p5_display_key", f"SELECT track_id, CASE WHEN track_id BETWEEN 't000150' AND 't000159' THEN 'C minor' WHEN track_id < 't000100' AND musical_key = '' THEN '0' ELSE musical_key END AS k FROM tracks", "tracks")
def p5(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.display_key(F.expr(KEYS)).alias("k"))


NEIGHBOURS = "CASE WHEN {k} = '' THEN '' ELSE concat((CAST(left({k}, len({k}) - 1) AS INT) + 10) % 12 + 1, right({k}, 1), ',', CAST(left({k}, len({k}) - 1) AS INT) % 12 + 1, right({k}, 1), ',', left({k}, len({k}) - 1), CASE right({k}, 1) WHEN 'A' THEN 'B' ELSE 'A' END) END"


@query("p6_key_neighbours", f"SELECT track_id, {NEIGHBOURS.format(k='musical_key')} AS neighbours FROM tracks", "tracks")
def p6(spark, sf):
    return view(spark, sf, "tracks").select("track_id", F.concat_ws(",", S.key_neighbours(C("musical_key"))).alias("neighbours"))


@query("p7_keys_compatible", f"SELECT track_id, musical_key <> '' AND (musical_key = '8A' OR list_contains(string_split({NEIGHBOURS.format(k='musical_key')}, ','), '8A')) AS compatible FROM tracks", "tracks")
def p7(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.keys_compatible(F.lit("8A"), C("musical_key")).alias("compatible"))


@query("p8_canonical_genre", "SELECT track_id, CASE WHEN genre IN ('Nu-Disco', 'Nu Disco') THEN 'Nu Disco' ELSE genre END AS genre FROM tracks", "tracks")
def p8(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.canonical_genre(C("genre")).alias("genre"))


def _case(column: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{other}' END"


TEXTURE_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(genre), '{p}') THEN '{v}' END" for p, v in S.TEXTURE_RULES) + "], lambda x: x IS NOT NULL)"
ENERGY_SQL = "CASE WHEN energy_rating IS NULL THEN 'medium' WHEN energy_rating <= 2 THEN 'low' WHEN energy_rating <= 4 THEN 'medium' WHEN energy_rating <= 6 THEN 'driving' ELSE 'peak' END"


@query("p9_mood", f"SELECT track_id, {_case('genre', S.MOOD_RULES, 'warm')} AS mood FROM tracks", "tracks")
def p9(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.mood(C("genre")).alias("mood"))


@query("p10_energy", f"SELECT track_id, {ENERGY_SQL} AS energy FROM tracks", "tracks")
def p10(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.energy(C("energy_rating")).alias("energy"))


@query("p11_textures", f"SELECT track_id, CASE WHEN len({TEXTURE_SQL}) = 0 THEN 'minimal' ELSE array_to_string({TEXTURE_SQL}, ',') END AS textures FROM tracks", "tracks")
def p11(spark, sf):
    return view(spark, sf, "tracks").select("track_id", F.concat_ws(",", S.textures(C("genre"))).alias("textures"))


@query("p12_studio_fields", f"""
SELECT track_id, CASE WHEN genre LIKE 'Nu%' THEN 'Nu Disco' ELSE genre END AS genre, nullif(musical_key, '') AS "key", {_case('genre', S.MOOD_RULES, 'warm')} AS mood, {ENERGY_SQL} AS energy,
  array_to_string(list_concat([CASE WHEN genre = '' THEN 'warm' WHEN genre LIKE 'Nu%' THEN 'Nu Disco' ELSE genre END, {ENERGY_SQL}], CASE WHEN len({TEXTURE_SQL}) = 0 THEN ['minimal'] ELSE {TEXTURE_SQL} END)[1:4], ',') AS tags,
  CASE WHEN musical_key <> '' OR genre <> '' OR bpm IS NOT NULL OR energy_rating IS NOT NULL THEN 'ok' ELSE 'missing-metadata' END AS analysis_status,
  CASE WHEN genre = '' THEN 'Demo library' WHEN genre LIKE 'Nu%' THEN 'Nu Disco' ELSE genre END AS cluster_name FROM tracks""", "tracks")
def p12(spark, sf):
    f = S.studio_fields(C("genre"), C("musical_key"), C("bpm"), C("energy_rating"))
    return view(spark, sf, "tracks").select("track_id", f["genre"].alias("genre"), f["key"].alias("key"), f["mood"].alias("mood"), f["energy"].alias("energy"), F.concat_ws(",", f["tags"]).alias("tags"), f["analysis_status"].alias("analysis_status"), f["cluster_name"].alias("cluster_name"))


@query("p13_tag_values", """
SELECT track_id, CASE WHEN track_id < 't000050' THEN NULL ELSE bpm END AS bpm, CASE WHEN musical_key <> '' THEN musical_key WHEN track_id < 't000100' THEN 'eyJrZXkiOiIifQ==' END AS k FROM tracks""", "tracks")
def p13(spark, sf):
    coded = F.base64(F.concat(F.lit('{"key":"'), C("musical_key"), F.lit('"}')).cast("binary"))
    tempo = F.when(C("track_id") < "t000050", F.lit("none")).otherwise(F.coalesce(C("bpm").cast("string"), F.lit("0")))
    tags = F.create_map(F.lit("bpm"), F.when(C("track_id") < "t000300", F.lit("x")).otherwise(tempo), F.lit("tbpm"), tempo, F.lit("initialkey"), F.when(C("track_id") < "t000100", coded).otherwise(C("musical_key")))
    return view(spark, sf, "tracks").withColumn("tags", tags).select("track_id", S.tag_bpm(C("tags")).alias("bpm"), S.tag_key(C("tags")).alias("k"))


@query("p14_device_path", "SELECT track_id, replace(lower(nfc_normalize(concat(substr(location, 2), CASE WHEN cluster < 5 THEN 'Stra\u00dfe/M\u00fcsic' ELSE '' END))), '\u00df', 'ss') AS path FROM tracks", "tracks")
def p14(spark, sf):
    place = F.concat(F.replace("location", F.lit("/"), F.lit("\\")), F.when(C("cluster") < 5, "Stra\u00dfe\\Mu\u0308sic/ ").otherwise(""))
    return view(spark, sf, "tracks").select("track_id", S.device_path()(F.concat(F.lit(" /"), place)).alias("path"))


@query("p15_content_type", "SELECT track_id, CASE WHEN track_id < 't000100' THEN 'audio/mp4' WHEN track_id < 't000200' THEN 'application/octet-stream' ELSE 'audio/wav' END AS kind FROM tracks", "tracks")
def p15(spark, sf):
    key = F.when(C("track_id") < "t000100", F.concat("track_id", F.lit(".M4A"))).when(C("track_id") < "t000200", F.lit("a.txt")).otherwise(C("location"))
    return view(spark, sf, "tracks").select("track_id", S.content_type(key).alias("kind"))


FNV = "list_reduce(list_prepend(CAST({start} AS BIGINT), list_transform(string_split({c}, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda h, v: (xor(h, v) * 16777619) & 4294967295)"


def fnv_sql(column: str, start: int = S.FNV_OFFSET) -> str:
    return FNV.format(c=column, start=start)


@query("p16_hash_geometry", f"""
WITH h AS (SELECT track_id, {fnv_sql('track_id')} AS h FROM tracks)
SELECT track_id, h, round(h / 4294967296.0, 9) AS unit, round(9 + cos(radians(CAST(h % 360 AS DOUBLE))) * (1.8 + (h % 80) / CAST(50 AS DOUBLE)), 9) AS x, round(1 + sin(radians(CAST(h % 360 AS DOUBLE))) * (0.15 + (h % 40) / CAST(220 AS DOUBLE)), 9) AS local_y FROM h""", "tracks")
def p16(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.fnv1a(C("track_id")).alias("h"), F.round(S.hash_unit(C("track_id")), 9).alias("unit"), F.round(S.hash_point(C("track_id"), 1.8, 80, 50.0)["x"] + 9, 9).alias("x"), F.round(S.hash_point(C("track_id"), 0.15, 40, 220.0)["y"] + 1, 9).alias("local_y"))


@query("p17_fit_dim", "SELECT vec_id, 80 AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total, round(list_sum(list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE))), 6) AS head FROM embeddings")
def p17(spark, sf):
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return view(spark, sf, "embeddings").select("vec_id", F.size(S.fit_dim(C("embedding"), 80)).alias("n"), total(S.fit_dim(C("embedding"), 80)).alias("total"), total(S.fit_dim(C("embedding"), 16)).alias("head"))


@query("p18_l2_normalize", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS first FROM embeddings")
def p18(spark, sf):
    return view(spark, sf, "embeddings").select("vec_id", F.round(S.l2_normalize(C("embedding"))[0], 6).alias("first"))


MOMENT_SQL = "CASE WHEN b < 116 AND e < 0.45 THEN 'Sunrise / ambient open' WHEN b < 122 AND v >= 0.5 AND e < 0.6 THEN 'Daytime beach club' WHEN b < 124 AND e < 0.55 THEN 'Sunset / golden hour' WHEN e >= 0.7 OR b >= 126 THEN 'Peak time' WHEN v < 0.4 AND e >= 0.5 THEN 'Deep / afterhours' ELSE 'Main floor' END"


@query("p20_suggested_moment", f"SELECT track_id, {MOMENT_SQL} AS moment FROM (SELECT track_id, coalesce(bpm, 122) AS b, coalesce(energy_rating, 5) / CAST(10 AS DOUBLE) AS e, created_at / CAST(1000 AS DOUBLE) AS v FROM tracks)", "tracks")
def p20(spark, sf):
    return view(spark, sf, "tracks").select("track_id", S.suggested_moment(C("bpm"), F.coalesce("energy_rating", F.lit(5)) / 10, C("created_at") / 1000).alias("moment"))


@query("p21_readiness", """
SELECT run_id, CASE WHEN r > 0 THEN 'processing_fast' WHEN t = 0 THEN 'imported' WHEN d < t THEN 'queued' WHEN f >= t THEN 'failed' WHEN f > 0 THEN 'degraded' ELSE 'ready_fast' END AS readiness
FROM (SELECT run_id, count(*) AS t, count(*) FILTER (status IN ('succeeded', 'skipped', 'failed')) AS d, count(*) FILTER (status = 'running') AS r, count(*) FILTER (status = 'failed') AS f FROM stages GROUP BY run_id)""", "stages")
def p21(spark, sf):
    s = view(spark, sf, "stages").groupBy("run_id").agg(F.count("*").alias("t"), F.count_if(C("status").isin("succeeded", "skipped", "failed")).alias("d"), F.count_if(C("status") == "running").alias("r"), F.count_if(C("status") == "failed").alias("f"))
    return s.select("run_id", S.readiness(F.lit(None).cast("string"), C("t"), C("d"), C("r"), C("f")).alias("readiness"))


@query("p22_analysis_status", "SELECT track_id, CASE cluster WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' ELSE CASE WHEN artist = '' THEN 'missing-metadata' ELSE 'pending' END END AS status, CASE WHEN genre = '' THEN 'missing' ELSE 'ready' END AS preview FROM tracks", "tracks")
def p22(spark, sf):
    ready = F.when(C("cluster") == 0, "failed").when(C("cluster") == 1, "degraded").otherwise("queued")
    return view(spark, sf, "tracks").select("track_id", S.analysis_status(ready, F.trim("artist") == "").alias("status"), S.preview_state(C("genre")).alias("preview"))


@query("p23_similarity_reasons", """
SELECT track_id, concat(CASE WHEN cluster = 0 THEN 'Prototype map distance — not sonic analysis · ' ELSE '' END, 'shared groove · ', format('{:.2f}', created_at / CAST(1000 AS DOUBLE) + 0.0001), ' neighbor score') AS reasons, CASE WHEN created_at / CAST(1000 AS DOUBLE) + 0.0001 < 0.72 THEN 'warning' ELSE 'distance' END AS kind FROM tracks""", "tracks")
def p23(spark, sf):
    r = S.similarity_reasons(C("cluster") == 0, F.array(F.lit("shared__groove"), F.lit(" ")), C("created_at") / 1000 + 0.0001)
    return view(spark, sf, "tracks").select("track_id", S.reason_text(r).alias("reasons"), F.element_at(r, -1)["kind"].alias("kind"))


@query("p25_plot_rows", """
SELECT track_id, title, CASE WHEN artist = '' THEN 'Unknown artist' ELSE artist END AS artist, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN cluster = 9 THEN -1 ELSE cluster END AS cluster, CASE WHEN cluster = 9 THEN 'Outliers / one-offs' ELSE concat('Cluster ', cluster) END AS cluster_name FROM tracks""", "tracks")
def p25(spark, sf):
    from tracklens.operators.filters import plot_rows

    t = view(spark, sf, "tracks").withColumn("cluster_id", F.when(C("cluster") == 9, F.lit("none")).otherwise(C("cluster").cast("string"))).drop("cluster")
    return plot_rows(t).select("track_id", "title", "artist", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster", "cluster_name")


@query("p26_evidence_key", "SELECT stage_id, concat('embedding:window', CASE WHEN attempt_count = 1 THEN ':drums' ELSE '' END, CASE WHEN retryable THEN concat(':', run_id, '-', run_id + 5, 'ms') ELSE '' END) AS k FROM stages", "stages")
def p26(spark, sf):
    key = S.evidence_key(F.lit("embedding"), F.lit("window"), F.when(C("attempt_count") == 1, "drums").otherwise(""), F.when(C("retryable"), C("run_id")), C("run_id") + 5)
    return view(spark, sf, "stages").select("stage_id", key.alias("k"))


@query("p27_cache_key", "SELECT stage_id, CASE WHEN cache_key IS NULL THEN NULL ELSE sha256(concat(cache_key, '|', extractor, '|v1|')) END AS k FROM stages", "stages")
def p27(spark, sf):
    return view(spark, sf, "stages").select("stage_id", S.cache_key(C("cache_key"), C("extractor"), F.lit("v1"), F.lit(None).cast("string")).alias("k"))


@query("p28_failure", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'missing_audio' WHEN 'purchase' THEN 'resource_exhausted' WHEN 'error' THEN 'corrupt_audio' WHEN 'signup' THEN 'transient_io' ELSE 'extractor_not_found' END AS code, event_type IN ('purchase', 'signup') AS retryable FROM events""")
def p28(spark, sf):
    name = F.when(C("event_type") == "click", "FileNotFoundError").when(C("event_type") == "purchase", "MemoryError").when(C("event_type") == "error", "ValueError").when(C("event_type") == "signup", "OSError").otherwise("KeyError")
    said = F.when(C("event_type") == "error", "could not Decode").otherwise("extractor x is not registered")
    f = S.failure(name, said)
    return view(spark, sf, "events").select("event_id", f["code"].alias("code"), f["retryable"].alias("retryable"))


@query("p29_failure_reason", r"SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 2000) AS reason FROM documents")
def p29(spark, sf):
    return view(spark, sf, "documents").select("doc_id", S.failure_reason(C("text")).alias("reason"))


PROMPT = "lower(CASE WHEN event_id % 3 = 0 THEN 'Darker percussive tracks around ' || (100 + event_id % 60) WHEN event_id % 3 = 1 THEN 'warm raw 8a peak ' || (90 + event_id % 70) || ' bpm' ELSE 'dreamy low' END)"


@query("p30_prompt_filters", f"""
WITH p AS (SELECT event_id, {PROMPT} AS p, CASE WHEN event_id % 3 = 0 THEN 100 + event_id % 60 WHEN event_id % 3 = 1 THEN 90 + event_id % 70 END AS c FROM events)
SELECT event_id, CASE WHEN c IS NOT NULL THEN least(greatest(c - 4, 108), 136) END::INT AS bpm_min, CASE WHEN c IS NOT NULL THEN least(greatest(c + 4, 108), 136) END::INT AS bpm_max,
  CASE event_id % 3 WHEN 1 THEN '8A' END AS "key", CASE event_id % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'warm' ELSE 'dreamy' END AS moods, CASE event_id % 3 WHEN 0 THEN 'percussive' WHEN 1 THEN 'raw' ELSE '' END AS textures, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'peak,driving' ELSE 'low' END AS energies,
  concat(CASE WHEN c IS NOT NULL THEN c || ' BPM ±4|' ELSE '' END, CASE event_id % 3 WHEN 0 THEN 'dark · percussive' WHEN 1 THEN '8A|warm · raw' ELSE 'dreamy' END, '|colored by mood') AS evidence
FROM p""")
def p30(spark, sf):
    prompt = F.expr("CASE WHEN event_id % 3 = 0 THEN concat('Darker percussive tracks around ', 100 + event_id % 60) WHEN event_id % 3 = 1 THEN concat('warm raw 8a peak ', 90 + event_id % 70, ' bpm') ELSE 'dreamy low' END")
    f = S.prompt_filters(C("p"), F.lit(108), F.lit(136))
    lists = {x: F.concat_ws(",", f[x]) for x in ("moods", "textures", "energies")} | {"evidence": F.concat_ws("|", f["evidence"])}
    return view(spark, sf, "events").select("event_id", prompt.alias("p")).select("event_id", *[(f | lists)[x].alias(x) for x in ("bpm_min", "bpm_max", "key", "moods", "textures", "energies", "evidence")])


@query("p31_looks_like_question", r"""
SELECT conv_id, turn, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> '' AND (regexp_matches(text, '(?i)\b(find|around|warmer|darker|raise|energy|percussive|similar|after this)\b') OR len(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+')) >= 5) AS ask FROM conversations""")
def p31(spark, sf):
    return view(spark, sf, "conversations").select("conv_id", "turn", S.looks_like_question(C("text")).alias("ask"))


@query("p32_clamp_filters", """
SELECT event_id, least(a, b) AS bpm_min, greatest(a, b) AS bpm_max, concat(CASE WHEN a = b THEN a || ' BPM' ELSE least(a, b) || '–' || greatest(a, b) || ' BPM' END, '|', CASE WHEN event_id % 2 = 0 THEN '8A · 9A' ELSE 'dark' END) AS chips
FROM (SELECT event_id, least(greatest(floor(100 + event_id % 40 + 0.5), 108), 136)::INT AS a, CASE WHEN event_id % 4 = 0 THEN 136 ELSE least(greatest(floor(140 - event_id % 50 + 0.5), 108), 136)::INT END AS b FROM events)""")
def p32(spark, sf):
    b = S.clamp_filters(F.expr("100 + event_id % 40"), F.expr("CASE WHEN event_id % 4 <> 0 THEN 140 - event_id % 50 END"), F.lit(108), F.lit(136))
    e = view(spark, sf, "events").select("event_id", b.alias("b")).select("event_id", C("b.bpm_min").cast("int").alias("bpm_min"), C("b.bpm_max").cast("int").alias("bpm_max"))
    even, none = C("event_id") % 2 == 0, F.array().cast("array<string>")
    chips = S.filter_chips(C("bpm_min"), C("bpm_max"), F.when(even, F.array(F.lit("8A"), F.lit("9A"))).otherwise(none), F.when(even, none).otherwise(F.array(F.lit("dark"))))
    return e.select("event_id", "bpm_min", "bpm_max", F.concat_ws("|", chips).alias("chips"))


@query("p33_clamp_score", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.5::DOUBLE ELSE least(greatest(value / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END AS score FROM events")
def p33(spark, sf):
    score = F.when(C("event_id") % 14 == 0, float("nan")).when(C("event_id") % 7 != 0, C("value") / 100)
    return view(spark, sf, "events").select("event_id", S.clamp_score(score).alias("score"))


@query("p34_blind_payload", "SELECT track_id, CASE WHEN cluster % 2 = 0 THEN title END AS title, CASE WHEN cluster % 2 = 0 THEN artist END AS artist FROM tracks", "tracks")
def p34(spark, sf):
    from tracklens.operators.evaluation import blind

    return blind(view(spark, sf, "tracks"), C("cluster") % 2 != 0, ["title", "artist"]).select("track_id", "title", "artist")


@query("p35_judgment_errors", """
SELECT judgment_id, CASE WHEN judgment_id % 5 = 0 THEN 'invalid triplet' WHEN judgment_id % 5 = 1 AND ordinal_rating + 1 > 4 THEN 'ordinal out of range' WHEN judgment_id % 5 = 2 THEN 'unsupported type' WHEN judgment_id % 5 = 3 THEN 'unsupported dimension' END AS error, judgment AS decision FROM judgments""", "judgments")
def p35(spark, sf):
    five = C("judgment_id") % 5
    kind = F.when(five == 0, "triplet").when(five == 1, "pair_rating").when(five == 2, "quadruplet").otherwise("top_k")
    decision = F.when(C("judgment") == "similar", "accepted").when(C("judgment") == "not_similar", "rejected").otherwise(C("judgment"))
    error = S.judgment_error(kind, decision, F.lit(None).cast("string"), C("ordinal_rating") + 1, F.when(five == 3, "mood").otherwise(C("dimension")))
    return view(spark, sf, "judgments").select("judgment_id", error.alias("error"), S.judgment_alias(decision).alias("decision"))


@query("p36_studio_tracks", f"""
SELECT track_id, CASE WHEN cluster = 1 THEN 'warm' ELSE {_case('genre', S.MOOD_RULES, 'warm')} END AS mood, 'vocal' AS textures, round(CASE WHEN cluster = 2 THEN cos(radians(CAST({fnv_sql('track_id')} % 360 AS DOUBLE))) * (1.8 + ({fnv_sql('track_id')} % 80) / CAST(50 AS DOUBLE)) ELSE x END, 6) AS x, CASE WHEN cluster = 2 THEN 'Unanalyzed' ELSE concat('Cluster ', cluster) END AS cluster_name FROM tracks""", "tracks")
def p36(spark, sf):
    from tracklens.operators.filters import studio_rows

    t = view(spark, sf, "tracks").select("track_id", F.when(C("cluster") == 1, "loud").otherwise(S.mood(C("genre"))).alias("mood"), F.lit("odd").alias("energy"), F.array(F.lit("vocal"), F.lit("odd")).alias("textures"), *[F.when(C("cluster") != 2, C(c)).alias(c) for c in ("x", "y", "cluster")])
    return studio_rows(t).select("track_id", "mood", F.concat_ws(",", "textures").alias("textures"), F.round("x", 6).alias("x"), "cluster_name")


PREFIXES = ["demo/", "libraries/demo/"]


@query("p39_allowed_keys", "SELECT track_id, cluster NOT IN (1, 2, 3) AS allowed FROM tracks", "tracks")
def p39(spark, sf):
    key = F.when(C("cluster") == 1, F.lit("/demo/a.mp3")).when(C("cluster") == 2, F.lit("demo/../a.mp3")).when(C("cluster") == 3, F.lit("other/a.mp3")).otherwise(F.lit(" demo/Fred again../a.mp3"))
    return view(spark, sf, "tracks").select("track_id", S.allowed_object_key(key, PREFIXES).alias("allowed"))


@query("p40_object_entries", f"""
SELECT track_id, concat('r2-', lpad(lower(hex({fnv_sql('k')})), 8, '0'), lpad(lower(hex({fnv_sql('k', 5381)})), 8, '0')) AS id, CASE WHEN cluster = 0 THEN 'Unknown artist' ELSE artist END AS artist, title FROM (SELECT *, CASE WHEN cluster = 0 THEN concat('demo/', replace(title, ' ', '_'), '.mp3') WHEN cluster = 1 THEN concat('demo/', artist, ' - ', title, '.mp3') ELSE concat('demo/Contents/', artist, '/x/', title, '.mp3') END AS k FROM tracks WHERE artist <> '')""", "tracks")
def p40(spark, sf):
    key = F.when(C("cluster") == 0, F.concat(F.lit("demo/"), F.replace("title", F.lit(" "), F.lit("_")), F.lit(".mp3"))).when(C("cluster") == 1, F.concat(F.lit("demo/"), "artist", F.lit(" - "), "title", F.lit(".mp3"))).otherwise(F.concat(F.lit("demo/Contents/"), "artist", F.lit("/x/"), "title", F.lit(".mp3")))
    e = S.object_entry(C("k"))
    return view(spark, sf, "tracks").where("artist <> ''").withColumn("k", key).select("track_id", *[e[x].alias(x) for x in ("id", "artist", "title")])
