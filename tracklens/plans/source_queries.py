"""Files: the queries write a table of the catalogue to the shared folder and read it by the source (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklens.plans.adapters import view
from tracklens.plans.base import query
from tracklens.sources import catalogue, sinks, tag_frames
from tracklens.sources.shared import shared_path

C = F.col


@query("s3_file_scan", "SELECT 'unsupported' AS status, '.txt' AS suffix, count(DISTINCT cluster) AS n FROM tracks", "tracks")
def s3(spark, sf):
    path = shared_path(spark, "scan")
    view(spark, sf, "tracks").select("title", "cluster").repartition(C("cluster")).write.partitionBy("cluster").text(path)
    return catalogue.scan_files(spark, path).where("NOT endswith(path, '_SUCCESS')").groupBy("status", "suffix").agg(F.count_distinct(F.regexp_extract("path", "cluster=([0-9]+)", 1)).alias("n"))


@query("s20_tag_frames", """
SELECT track_id, title, artist, genre, CASE WHEN track_id < 't000050' OR bpm <= 0 THEN NULL ELSE bpm END AS bpm,
  CASE WHEN musical_key <> '' THEN musical_key END AS "key", 'found' AS status FROM tracks""", "tracks")
def s20(spark, sf):
    """A file for each track, whose tags hold what the catalogue knows of it."""
    path = shared_path(spark, "tags")
    coded = F.base64(F.concat(F.lit('{"key":"'), C("musical_key"), F.lit('"}')).cast("binary"))
    tempo = F.when(C("track_id") < "t000050", F.lit("none")).otherwise(C("bpm").cast("string"))
    tags = F.create_map(F.lit("title"), C("title"), F.lit("artist"), C("artist"), F.lit("genre"), C("genre"), F.lit("tbpm"), tempo, F.lit("initialkey"), F.when((C("track_id") < "t000100") & (C("musical_key") != ""), coded).otherwise(C("musical_key")))
    tag_frames.write_heads(view(spark, sf, "tracks").select(F.concat("track_id", F.lit(".mp3")).alias("name"), tags.alias("tags")), path)
    found = tag_frames.tag_metadata(tag_frames.load_tags(spark, path))
    return found.select(F.regexp_extract("path", r"([^/]+)\.mp3$", 1).alias("track_id"), "title", "artist", "genre", "bpm", "key", "status")


@query("s4_content_hash", "SELECT sha256(string_agg(concat(track_id, chr(10)), '' ORDER BY track_id)) AS content_hash, 8 * count(*) AS size FROM tracks GROUP BY title", "tracks")
def s4(spark, sf):
    """A file for each title, with all of its tracks."""
    path = shared_path(spark, "hash")
    view(spark, sf, "tracks").select(C("track_id").alias("text"), "title").repartition(C("title")).sortWithinPartitions("title", "text").write.partitionBy("title").text(path)
    return catalogue.scan_files(spark, path).where("size > 0").select("content_hash", "size")


@query("s5_csv_source", "SELECT track_id, title, artist, bpm, musical_key AS \"key\", CASE WHEN cluster = 1 THEN NULL ELSE energy_rating END AS rating FROM tracks", "tracks")
def s5(spark, sf):
    path = shared_path(spark, "csv")
    t = view(spark, sf, "tracks").select("track_id", F.concat(F.lit(" "), "title").alias("title"), "artist", "bpm", C("musical_key").alias("key"), F.when(C("cluster") == 1, "x").otherwise(C("energy_rating").cast("double").cast("string")).alias("rating"))
    t.write.option("header", True).option("emptyValue", "").csv(path)
    return catalogue.load_csv(spark, path).select("track_id", "title", "artist", "bpm", "key", "rating")


@query("s6_xml_source", "SELECT track_id, title, bpm, concat('/Music/a+b/', title, '.wav') AS location, CASE WHEN energy_rating IS NULL THEN 0 ELSE round_even(energy_rating * 20 / CAST(51 AS DOUBLE), 0)::INT END AS rating FROM tracks", "tracks")
def s6(spark, sf):
    path = shared_path(spark, "xml")
    t = view(spark, sf, "tracks").select(C("track_id").alias("_TrackID"), C("title").alias("_Name"), C("bpm").alias("_AverageBpm"), (C("energy_rating") * 20).alias("_Rating"), F.concat(F.lit("file://localhost/Music/a+b/"), F.replace("title", F.lit(" "), F.lit("%20")), F.lit(".wav")).alias("_Location"))
    t.write.format("xml").option("rowTag", "TRACK").option("rootTag", "COLLECTION").save(path)
    return catalogue.load_xml(spark, path).select("track_id", "title", "bpm", "location", "rating")


@query("s7_playlists", "SELECT CAST(user_id AS VARCHAR) AS file, concat('Sets/', event_type) AS crate, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::INT AS position, CAST(event_id AS VARCHAR) AS track_id FROM events")
def s7(spark, sf):
    e = view(spark, sf, "events")
    nodes = e.groupBy("user_id", "event_type").agg(F.concat_ws("", F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit('<TRACK Key="'), C("event_id").cast("string"), F.lit('"/>')).alias("x"))))["x"]).alias("x"))
    files = nodes.groupBy("user_id").agg(F.concat_ws("", F.collect_list(F.concat(F.lit('<NODE Type="1" Name="'), "event_type", F.lit('">'), "x", F.lit("</NODE>")))).alias("x"))
    return catalogue.playlists(files.select(C("user_id").cast("string").alias("file"), F.concat(F.lit('<DJ_PLAYLISTS><PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="Sets">'), "x", F.lit("</NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>")).alias("xml")))


@query("s10_jsonl_cache", "SELECT cache_key, max(stage_id) AS stage_id FROM stages WHERE cache_key IS NOT NULL GROUP BY cache_key", "stages")
def s10(spark, sf):
    path = shared_path(spark, "jsonl")
    view(spark, sf, "stages").where("cache_key IS NOT NULL").select("cache_key", "stage_id").write.json(path)
    return catalogue.load_jsonl(spark, path, "cache_key string, stage_id long", ["cache_key"], "stage_id").select("cache_key", "stage_id")


@query("s11_snapshot", "SELECT track_id, title FROM tracks WHERE cluster = 2", "tracks")
def s11(spark, sf):
    path, t = shared_path(spark, "snapshot"), view(spark, sf, "tracks").select("track_id", "title", "cluster")
    sinks.write_snapshot(t.where("cluster = 1"), path, 1)
    sinks.write_snapshot(t.where("cluster = 3"), path, 2)
    sinks.write_snapshot(t.where("cluster = 2"), path, 1)
    return sinks.read_snapshot(spark, path, 1).select("track_id", "title")


def items(spark, sf):
    return view(spark, sf, "events").where("event_type = 'click'").selectExpr("concat('Crate ', user_id) AS crate", "event_id AS position", "concat('t', lpad(CAST(event_id % 900 AS STRING), 6, '0')) AS track_id")


ITEMS = "items AS (SELECT concat('Crate ', user_id) AS crate, event_id AS position, concat('t', lpad(CAST(event_id % 900 AS VARCHAR), 6, '0')) AS track_id FROM events WHERE event_type = 'click')"


def exported(spark, sf):
    return view(spark, sf, "tracks").withColumnRenamed("musical_key", "key")


@query("s12_csv_export", f"WITH {ITEMS} SELECT track_id, title, artist, coalesce(CAST(bpm AS VARCHAR), '') AS bpm, crate, CAST(position AS VARCHAR) AS position FROM items JOIN tracks USING (track_id)", "tracks")
def s12(spark, sf):
    path = shared_path(spark, "export")
    sinks.write_csv(sinks.csv_rows(items(spark, sf), exported(spark, sf)), path)
    back = spark.read.option("header", True).csv(path)
    return back.fillna("").select("track_id", "title", "artist", "bpm", "crate", "position")


@query("s13_m3u_export", f"""
WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY crate ORDER BY position, track_id) AS n FROM items JOIN tracks USING (track_id))
SELECT crate, 0 AS line, '#EXTM3U' AS text FROM (SELECT DISTINCT crate FROM items) UNION ALL SELECT crate, 1, concat('#PLAYLIST:', crate) FROM (SELECT DISTINCT crate FROM items)
UNION ALL SELECT crate, (2 * n)::INT, concat('#EXTINF:', duration_sec::BIGINT, ',', CASE WHEN artist = '' THEN '' ELSE artist || ' - ' END, title) FROM n UNION ALL SELECT crate, (2 * n + 1)::INT, location FROM n""", "tracks")
def s13(spark, sf):
    return sinks.m3u_lines(items(spark, sf), exported(spark, sf))


@query("s14_xml_export")
def s14(spark, sf):
    t = exported(spark, sf)
    assigned = t.where("cluster < 4").select("track_id", (C("cluster") - 1).alias("cluster"), F.concat(F.lit("Cluster "), C("cluster").cast("string")).alias("cluster_name"), F.when(C("cluster") > 0, "Peak time").alias("moment"), F.xxhash64("track_id").bitwiseAND(F.lit((1 << 40) - 1)).alias("position"))
    return sinks.collection_lines("x1", t, items(spark, sf), assigned, "Tracklens").orderBy("section", "major", "minor")


UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE))))"


@query("s16_partition_replace", f"""
WITH u AS (SELECT track_id, cluster, {UNIT} AS u FROM tracks), p AS (SELECT 'r1' AS run_id, 'sound & tone' AS channel, * FROM u WHERE cluster = 2 UNION ALL SELECT 'r2', 'global', * FROM u WHERE cluster = 3),
k AS (SELECT a.run_id, a.channel, a.track_id AS source, b.track_id AS target, greatest(-1, least(1, list_sum(list_transform(list_zip(a.u, b.u), lambda t: t[1] * t[2])))) AS score FROM p a JOIN p b ON a.run_id = b.run_id AND a.track_id <> b.track_id),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY score DESC, target)::INT AS rank FROM k)
SELECT run_id, channel, source, target, rank, round(score, 6) AS score, 'm' AS model FROM r WHERE rank <= 3""", "tracks")
def s16(spark, sf):
    """Neighbours of two runs; one is stored twice, and one of a single track leaves its partition empty."""
    from tracklens.operators.similarity import materialize_neighbours

    path, t = shared_path(spark, "neighbours"), view(spark, sf, "tracks")
    runs = spark.createDataFrame([(r, "completed") for r in ("r1", "r2", "r3")], "run_id string, status string")
    vectors = lambda run, rows: rows.select(F.lit(run).alias("run_id"), F.lit("track").alias("scope"), F.lit("k").alias("embedding_key"), "track_id", F.lit("m").alias("model_name"), F.lit("1").alias("model_version"), F.lit("mean").alias("pooling_strategy"), "embedding")
    for run, channel, rows in (("r1", "sound & tone", "cluster = 1"), ("r2", "global", "cluster = 3"), ("r3", "global", "cluster = 1"), ("r3", "global", "track_id = 't000001'"), ("r1", "sound & tone", "cluster = 2")):
        materialize_neighbours(vectors(run, t.where(rows)), runs, path, run, channel, "k", 3)
    return spark.read.parquet(path).select("run_id", "channel", C("source_track_id").alias("source"), C("target_track_id").alias("target"), "rank", F.round("score", 6).alias("score"), C("provenance.model_name").alias("model"))


@query("s17_vector_codec", "SELECT vec_id, 256 AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def s17(spark, sf):
    e = view(spark, sf, "embeddings").select("vec_id", catalogue.encode_vectors()("embedding").alias("blob"))
    back = e.select("vec_id", F.octet_length("blob").alias("bytes"), catalogue.decode_vectors()("blob").alias("v"))
    return back.select("vec_id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("s19_vector_store", "SELECT track_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding) AS v FROM tracks", "tracks")
def s19(spark, sf):
    path = shared_path(spark, "vectors")
    view(spark, sf, "tracks").select("track_id", "embedding").write.parquet(path)
    return spark.read.parquet(path).select("track_id", F.posexplode("embedding").alias("pos", "v"))
