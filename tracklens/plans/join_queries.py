"""Scans, filters and joins over the catalogue (S*, F*, J*, E*, M*, U*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.operators import filters, joins, merges
from tracklens.operators.text_index import TextIndex
from tracklens.plans.adapters import view
from tracklens.plans.base import query
from tracklens.plans.scalar_queries import ENERGY_SQL, NEIGHBOURS, _case, fnv_sql
from tracklens.sources.shared import shared_path

C = F.col


@query("s1_catalogue_scan", "SELECT track_id, title, artist, bpm FROM tracks WHERE library_id = 'L1'", "tracks")
def s1(spark, sf):
    return view(spark, sf, "tracks").where("library_id = 'L1'").select("track_id", "title", "artist", "bpm").orderBy("artist", "title")


@query("s2_point_lookup", "SELECT track_id, title, artist FROM tracks WHERE track_id = 't000042'", "tracks")
def s2(spark, sf):
    return view(spark, sf, "tracks").where("track_id = 't000042'").select("track_id", "title", "artist")


@query("s8_lookup_index", """
SELECT c_custkey, n_name AS artist, r_name AS album, lower(c_name) AS path, c_acctbal / 100 AS tempo FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def s8(spark, sf):
    from tracklens.sources.catalogue import resolve_lookups

    rows = view(spark, sf, "customer").select("c_custkey", C("c_nationkey").alias("artist_id"), C("c_name").alias("location"), C("c_acctbal").alias("tempo"))
    nation = view(spark, sf, "nation")
    rows = rows.join(nation.select(C("n_nationkey").alias("artist_id"), C("n_regionkey").alias("album_id")), "artist_id", "left")
    out = resolve_lookups(rows, artist=nation.select(C("n_nationkey").alias("id"), C("n_name").alias("name")), album=view(spark, sf, "region").select(C("r_regionkey").alias("id"), C("r_name").alias("name")))
    return out.select("c_custkey", "artist", "album", "path", "tempo")


STUDIO = f"""st AS (SELECT *, {_case('genre', S.MOOD_RULES, 'warm')} AS mood, {ENERGY_SQL} AS energy FROM tracks)"""


def studio(spark, sf):
    f = S.studio_fields(C("genre"), C("musical_key"), C("bpm"), C("energy_rating"))
    return view(spark, sf, "tracks").withColumns({"mood": f["mood"], "energy": f["energy"], "textures": f["textures"], "cluster_name": f["cluster_name"], "hidden": F.lit(False), "analysis_status": f["analysis_status"]})


@query("f1_studio_filter", f"""
WITH {STUDIO} SELECT track_id FROM st WHERE lower(concat(title, ' ', artist, ' ', label, ' ', genre)) LIKE '%house%' AND bpm BETWEEN 110 AND 130 AND mood IN ('warm', 'hypnotic', 'euphoric') AND energy IN ('medium', 'driving')
  AND musical_key <> '' AND (musical_key = '8A' OR list_contains(string_split({NEIGHBOURS.format(k='musical_key')}, ','), '8A')) AND abs(bpm - 120) <= 4""", "tracks")
def f1(spark, sf):
    f = filters.StudioFilter(query="House", bpm=(110, 130), moods=["warm", "hypnotic", "euphoric"], energies=["medium", "driving"], compatible_keys=True, bpm_near_seed=True)
    return studio(spark, sf).drop("cluster_name").withColumn("cluster_name", F.lit("")).where(filters.studio_predicate(f, {"bpm": 120.0, "musical_key": "8A"})).select("track_id")


@query("f3_map_filter", f"WITH {STUDIO} SELECT track_id FROM st WHERE bpm >= 112 AND bpm <= 128 AND cluster IN (0, 1, 5) AND mood IN ('warm', 'dark')", "tracks")
def f3(spark, sf):
    return studio(spark, sf).where(filters.map_predicate(112, 128, [0, 1, 5], ["Warm", "DARK"])).select("track_id")


@query("f4_merge_filters", """
SELECT event_id, greatest(CASE WHEN event_id % 3 <> 0 THEN 100 + event_id % 20 END, 110)::INT AS bpm_min, least(CASE WHEN event_id % 3 <> 0 THEN 130 - event_id % 20 END, 128)::INT AS bpm_max, CASE WHEN event_id % 2 = 0 THEN '2,3' ELSE '1,2,3' END AS clusters FROM events""")
def f4(spark, sf):
    specs = view(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 3 <> 0 THEN CAST(100 + event_id % 20 AS INT) END AS a_bpm_min", "CASE WHEN event_id % 3 <> 0 THEN CAST(130 - event_id % 20 AS INT) END AS a_bpm_max", "110 AS b_bpm_min", "128 AS b_bpm_max", "array(1, 2, 3) AS a_clusters", "CASE WHEN event_id % 2 = 0 THEN array(2, 3, 4) END AS b_clusters")
    return filters.merge_filters(specs).select("event_id", "bpm_min", "bpm_max", F.concat_ws(",", C("clusters").cast("array<string>")).alias("clusters"))


@query("f5_library_views", """
SELECT track_id, 'unplayed' AS kind FROM tracks WHERE track_id NOT IN (SELECT concat('t', lpad(CAST(user_id % 300 AS STRING), 6, '0')) FROM events)
UNION ALL SELECT track_id, 'recent' FROM tracks WHERE created_at >= 900 UNION ALL SELECT track_id, 'focus' FROM tracks WHERE cluster = 3""", "tracks")
def f5(spark, sf):
    t, plays = view(spark, sf, "tracks"), view(spark, sf, "events").selectExpr("concat('t', lpad(CAST(user_id % 300 AS STRING), 6, '0')) AS track_id")
    kinds = {"unplayed": {}, "recent": {"cutoff": 900}, "focus": {"focus": t.where("cluster = 3")}}
    parts = [filters.library_view(t, plays, kind, **more).select("track_id", F.lit(kind).alias("kind")) for kind, more in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("f6_search_page", "SELECT track_id, created_at FROM tracks WHERE lower(artist) LIKE '%artist 1%' OR lower(title) LIKE '%artist 1%' ORDER BY created_at DESC, track_id LIMIT 20 OFFSET 10", "tracks")
def f6(spark, sf):
    return filters.search_page(view(spark, sf, "tracks"), "Artist 1", 10, 20).select("track_id", "created_at")


@query("f6_indexed_search", "SELECT track_id, created_at FROM tracks WHERE lower(concat(coalesce(title, ''), ' ', coalesce(artist, ''))) LIKE '%artist 1%' ORDER BY created_at DESC, track_id LIMIT 20 OFFSET 10", "tracks")
def f6_index(spark, sf):
    """The same page from an index built on all tracks."""
    return TextIndex.build(view(spark, sf, "tracks"), shared_path(spark, "texts")).search("Artist 1", 10, 20)


@query("f7_visible_rows", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'")
def f7(spark, sf):
    libraries = view(spark, sf, "customer").select(C("c_custkey").alias("library_id"), C("c_nationkey").alias("owner_id"), F.when(C("c_mktsegment") == "BUILDING", "demo").otherwise("own").alias("source"))
    return filters.visible_to(view(spark, sf, "orders").select("o_orderkey", C("o_custkey").alias("library_id")), libraries, 3).select("o_orderkey")


@query("f8_rankable", "SELECT track_id FROM tracks WHERE cluster <> 4 AND energy_rating IS NOT NULL", "tracks")
def f8(spark, sf):
    t = view(spark, sf, "tracks").withColumn("analysis_status", F.when(C("cluster") == 4, "failed").otherwise("ok")).withColumn("hidden", C("energy_rating").isNull())
    return filters.rankable(t).select("track_id")


#: Names of source rows: every fifth id is another row's, too; names past the catalogue's match nothing.
NUMBER = "CASE WHEN event_id % 5 = 0 THEN event_id + 1 ELSE event_id END"
ROWS = f"rows_ AS (SELECT event_id, concat('track', CAST({NUMBER} AS STRING)) AS t, concat('artist', CAST(({NUMBER}) % 40 AS STRING)) AS a FROM events)"
IDENT = "ident AS (SELECT track_id, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS t, lower(regexp_replace(artist, '[^A-Za-z0-9]', '', 'g')) AS a FROM tracks)"
J1_SQL = f"""
WITH {ROWS}, {IDENT}, bt AS (SELECT t, a, count(*) AS n, min(track_id) AS track FROM ident GROUP BY t, a), br AS (SELECT t, a, count(*) AS n FROM rows_ GROUP BY t, a)
SELECT event_id, CASE WHEN bt.n = 1 AND br.n = 1 THEN 'matched' WHEN bt.n IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN bt.n = 1 AND br.n = 1 THEN track END AS matched_track_id FROM rows_ JOIN br USING (t, a) LEFT JOIN bt USING (t, a)"""


def identity_match(spark, sf):
    # composed, decomposed and full-width spellings of one name
    word = "CASE event_id % 4 WHEN 0 THEN 'TRACK-' WHEN 1 THEN 'Tr\u00e1ck ' WHEN 2 THEN 'Tra\u0301ck. ' ELSE '\uff34\uff52\uff41\uff43\uff4b ' END"
    rows = view(spark, sf, "events").selectExpr("event_id", f"concat({word}, CAST({NUMBER} AS STRING)) AS title", f"concat('Artist, ', CAST(({NUMBER}) % 40 AS STRING)) AS artist")
    fold = S.identity_unicode()
    ident = lambda df: df.withColumn("t", fold("title")).withColumn("a", fold("artist"))
    return joins.unique_identity_join(ident(view(spark, sf, "tracks")), ident(rows), ["t", "a"])


@query("j1_identity_join", J1_SQL, "tracks")
def j1(spark, sf):
    return identity_match(spark, sf).select("event_id", "status", "matched_track_id")


@query("j2_device_path_join", "SELECT track_id, bpm AS export_bpm FROM tracks", "tracks")
def j2(spark, sf):
    t = view(spark, sf, "tracks").select("track_id", "bpm", S.device_path()(C("location")).alias("path"))
    export = t.select("path", C("bpm").alias("export_bpm"))
    return joins.closed_join(t.select("track_id", "path"), export, "path").select("track_id", "export_bpm")


@query("j3_run_stages", "SELECT stage_id, o_orderstatus AS run_status, p_brand AS title FROM stages JOIN orders ON run_id = o_orderkey JOIN part ON track_id = p_partkey", "stages")
def j3(spark, sf):
    runs = view(spark, sf, "orders").select(C("o_orderkey").alias("run_id"), C("o_orderstatus").alias("run_status"))
    tracks = view(spark, sf, "part").select(C("p_partkey").alias("track_id"), C("p_brand").alias("title"))
    return view(spark, sf, "stages").join(runs, "run_id").join(tracks, "track_id").select("stage_id", "run_status", "title")


RESULTS = """results AS (SELECT c AS configuration_id, a.track_id AS anchor_track_id, b.track_id AS candidate_track_id, row_number() OVER (PARTITION BY c, a.track_id ORDER BY (b.created_at * (CASE c WHEN 'c1' THEN 1 ELSE 7 END)) % 1009, b.track_id) AS rank
  FROM (SELECT unnest(['c1', 'c2']) AS c), (SELECT * FROM tracks WHERE track_id < 't000008') a, tracks b WHERE a.track_id <> b.track_id)"""


def results(spark, sf):
    """A frozen ranking of all tracks for each of eight anchors and two configurations."""
    t = view(spark, sf, "tracks")
    anchors = t.where("track_id < 't000008'").select(C("track_id").alias("anchor_track_id"))
    pairs = t.select("track_id", "created_at").join(F.broadcast(anchors), C("track_id") != C("anchor_track_id")).select("anchor_track_id", C("track_id").alias("candidate_track_id"), "created_at", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("configuration_id"))
    ranking = ["configuration_id", "anchor_track_id"]
    pairs = pairs.withColumn("_p", (C("created_at") * F.when(C("configuration_id") == "c1", 1).otherwise(7)) % 1009).drop("created_at")
    # rows are ranked within a place; the counts of the places before, at most 1009 a ranking, are added
    before = Window.partitionBy(*ranking).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = pairs.groupBy(*ranking, "_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*ranking, "_p").orderBy("candidate_track_id"))
    return pairs.withColumn("_i", within).join(starts, [*ranking, "_p"]).withColumn("rank", C("_i") + C("_b")).drop("_p", "_i", "_b")


TRIPLETS = "triplets AS (SELECT judgment_id, configuration_id, anchor_track_id, concat('t', lpad(CAST(judgment_id % 97 AS STRING), 6, '0')) AS candidate_a, concat('t', lpad(CAST(judgment_id % 89 + 3 AS STRING), 6, '0')) AS candidate_b, CASE WHEN judgment = 'similar' THEN 'a_closer' WHEN judgment = 'skip' THEN 'tie' ELSE 'b_closer' END AS decision, dimension FROM judgments)"


def triplets(spark, sf):
    return view(spark, sf, "judgments").selectExpr("judgment_id", "configuration_id", "anchor_track_id", "concat('t', lpad(CAST(judgment_id % 97 AS STRING), 6, '0')) AS candidate_a", "concat('t', lpad(CAST(judgment_id % 89 + 3 AS STRING), 6, '0')) AS candidate_b", "CASE WHEN judgment = 'similar' THEN 'a_closer' WHEN judgment = 'skip' THEN 'tie' ELSE 'b_closer' END AS decision", "dimension")


@query("j5_frozen_ranks", f"""
WITH {RESULTS}, {TRIPLETS} SELECT judgment_id, ra.rank::INT AS rank_a, rb.rank::INT AS rank_b FROM triplets t LEFT JOIN results ra ON t.configuration_id = ra.configuration_id AND t.anchor_track_id = ra.anchor_track_id AND t.candidate_a = ra.candidate_track_id
  LEFT JOIN results rb ON t.configuration_id = rb.configuration_id AND t.anchor_track_id = rb.anchor_track_id AND t.candidate_b = rb.candidate_track_id""", "tracks judgments")
def j5(spark, sf):
    return joins.frozen_ranks(triplets(spark, sf), results(spark, sf)).select("judgment_id", "rank_a", "rank_b")


@query("j6_set_counts", "SELECT c_custkey AS set_id, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderpriority) AS priorities FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j6(spark, sf):
    rows = view(spark, sf, "orders").withColumnRenamed("o_custkey", "set_id")
    return joins.counts_per(view(spark, sf, "customer").select(C("c_custkey").alias("set_id")), "set_id", orders=(rows, C("o_orderkey")), priorities=(rows, C("o_orderpriority")))


@query("j7_candidate_pools", """
SELECT a.track_id AS anchor_track_id, b.track_id AS candidate_track_id FROM tracks a JOIN tracks b ON a.track_id <> b.track_id AND CASE WHEN a.cluster = 0 THEN b.track_id IN ('t000001', 't000002', a.track_id) ELSE a.library_id = b.library_id AND a.title = b.title END""", "tracks")
def j7(spark, sf):
    t = view(spark, sf, "tracks")
    own = F.concat_ws("/", "library_id", "title")  # a set: the tracks of a library under one title
    anchors = t.select(C("track_id").alias("anchor_track_id"), own.alias("set_id"), F.when(C("cluster") == 0, F.array(F.lit("t000001"), F.lit("t000002"), C("track_id"))).alias("pool"))
    return joins.pool_candidates(anchors, t.select(own.alias("set_id"), "track_id"))


@query("j8_set_detail", "SELECT c_custkey AS set_id, o_orderkey AS latest_run, n_name AS library FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def j8(spark, sf):
    from tracklens.operators.ranking import latest

    runs = latest(view(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(C("o_custkey").alias("c_custkey"), C("o_orderkey").alias("latest_run"))
    nation = view(spark, sf, "nation").select(C("n_nationkey").alias("c_nationkey"), C("n_name").alias("library"))
    return view(spark, sf, "customer").join(nation, "c_nationkey").join(runs, "c_custkey", "left").select(C("c_custkey").alias("set_id"), "latest_run", "library")


@query("j9_failed_stages", "SELECT run_id, extractor, p_brand AS title FROM stages JOIN part ON track_id = p_partkey WHERE status = 'failed'", "stages")
def j9(spark, sf):
    configs = view(spark, sf, "orders").select(C("o_orderkey").alias("run_id"))
    tracks = view(spark, sf, "part").select(C("p_partkey").alias("track_id"), C("p_brand").alias("title"))
    return view(spark, sf, "stages").where("status = 'failed'").join(configs, "run_id").join(tracks, "track_id").select("run_id", "extractor", "title")


@query("j10_neighbour_groups", f"""
WITH {RESULTS} SELECT anchor_track_id, configuration_id, string_agg(candidate_track_id, ',' ORDER BY rank) AS ranked, CASE configuration_id WHEN 'c2' THEN 1 ELSE 2 END AS position FROM results WHERE rank <= 5 GROUP BY anchor_track_id, configuration_id""", "tracks")
def j10(spark, sf):
    configs = spark.range(1).select(F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("configuration_id"))
    groups = joins.neighbour_groups(results(spark, sf).where("rank <= 5"), configs, view(spark, sf, "tracks").select("track_id", "title"), ["c2", "c1"])
    return groups.select("anchor_track_id", "configuration_id", F.concat_ws(",", "ranked.track_id").alias("ranked"), C("position").cast("int").alias("position"))


@query("j11_reuse_evidence", """
SELECT t.stage_id, max_by(d.stage_id, (d.finished_at, -d.stage_id)) AS donor_id FROM stages t JOIN stages d ON t.cache_key = d.cache_key AND t.stage_id <> d.stage_id AND d.status = 'succeeded' WHERE t.status = 'queued' GROUP BY t.stage_id, t.cache_key""", "stages")
def j11(spark, sf):
    s = view(spark, sf, "stages")
    return joins.reuse_evidence(s.where("status = 'queued'").select("stage_id", "cache_key").distinct(), s).select("stage_id", "donor_id")


@query("j12_reusable_analysis", """
SELECT stage_id, min(donor) AS donor FROM (SELECT a.stage_id, b.stage_id AS donor FROM stages a JOIN stages b ON a.track_id = b.track_id AND a.cache_key = b.cache_key AND a.extractor = b.extractor AND a.run_id <> b.run_id AND b.status = 'succeeded') GROUP BY stage_id""", "stages")
def j12(spark, sf):
    s = view(spark, sf, "stages").where("cache_key IS NOT NULL")
    keys = ["track_id", "cache_key", "extractor"]
    donors = s.where("status = 'succeeded'").groupBy(*keys, "run_id").agg(F.min("stage_id").alias("donor"))
    # of each identity the first donors of two runs suffice: only one can be the row's own run
    two = donors.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("donor"))).where("_n <= 2").withColumnRenamed("run_id", "donor_run")
    return s.join(two, keys).where("run_id <> donor_run").groupBy("stage_id").agg(F.min("donor").alias("donor"))


@query("j13_run_embeddings", "SELECT cluster AS run_id, track_id FROM tracks WHERE energy_rating IS NULL OR energy_rating <> 3", "tracks")
def j13(spark, sf):
    t = view(spark, sf, "tracks").withColumn("status", F.when(C("energy_rating") == 3, "failed").otherwise("ok"))
    usable = t.where("status IN ('ok', 'skipped') AND size(embedding) > 0").select(C("cluster").alias("run_id"), "track_id", "embedding")
    return joins.first_per(usable, ["run_id", "track_id"], ["track_id"]).select("run_id", "track_id")


@query("j14_eligible_stages", """
SELECT stage_id FROM stages s WHERE (status = 'queued' OR (status = 'failed' AND retryable AND attempt_count < 3)) AND run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM stages r WHERE r.status = 'running' AND r.cache_key = s.cache_key)""", "stages")
def j14(spark, sf):
    cancelled = view(spark, sf, "orders").where("o_orderstatus = 'F'").select(C("o_orderkey").alias("run_id"))
    return joins.eligible_stages(view(spark, sf, "stages"), cancelled, None, 3).select("stage_id")


@query("j15_import_split", "SELECT e.track_id, CASE WHEN cluster = 7 THEN 'insert' WHEN bpm > 120 THEN 'update' ELSE 'keep' END AS action FROM tracks e", "tracks")
def j15(spark, sf):
    t = view(spark, sf, "tracks")
    old = t.where("cluster <> 7").select("track_id", F.least("bpm", F.lit(120.0)).alias("old_bpm"), F.lit(True).alias("_here"))
    return joins.split_import(t.select("track_id", "bpm"), old, "track_id", C("n.bpm") > C("o.old_bpm")).select("track_id", "action")


@query("j16_crate_rows", "SELECT user_id AS crate_id, event_id AS position, track_id, title FROM events JOIN tracks ON track_id = concat('t', lpad(CAST(event_id % 900 AS STRING), 6, '0')) WHERE event_type = 'click'", "tracks")
def j16(spark, sf):
    items = view(spark, sf, "events").where("event_type = 'click'").selectExpr("user_id AS crate_id", "event_id AS position", "concat('t', lpad(CAST(event_id % 900 AS STRING), 6, '0')) AS track_id")
    return joins.crate_rows(items, view(spark, sf, "tracks").select("track_id", "title")).select("crate_id", "position", "track_id", "title")


@query("j17_cards", """
WITH r AS (SELECT user_id AS request_id, concat('t', lpad(CAST(event_id % 900 AS STRING), 6, '0')) AS track_id, min(event_id) AS position FROM events GROUP BY ALL),
k AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY position) AS n FROM r JOIN tracks USING (track_id)) SELECT request_id, track_id, position FROM k WHERE n <= 8""", "tracks")
def j17(spark, sf):
    said = view(spark, sf, "events").selectExpr("user_id AS request_id", "event_id AS position", "concat('t', lpad(CAST(event_id % 900 AS STRING), 6, '0')) AS track_id")
    return joins.cards(said, view(spark, sf, "tracks").select("track_id")).select("request_id", "track_id", "position")


@query("j18_neighbour_order", f"WITH {RESULTS} SELECT anchor_track_id, track_id, rank::INT AS rank FROM results JOIN tracks ON track_id = candidate_track_id WHERE configuration_id = 'c1' AND rank <= 50 AND cluster <> 2", "tracks")
def j18(spark, sf):
    t = view(spark, sf, "tracks").select("track_id", (C("cluster") == 2).alias("hidden"))
    n = results(spark, sf).where("configuration_id = 'c1' AND rank <= 50").withColumnRenamed("candidate_track_id", "track_id")
    return joins.order_by_neighbours(t, n).select("anchor_track_id", "track_id", "rank")


@query("j19_coordinates", f"""
SELECT track_id, round(CASE WHEN cluster < 5 THEN x WHEN cluster < 8 THEN y ELSE cos(radians(CAST({fnv_sql('track_id')} % 360 AS DOUBLE))) * (0.15 + ({fnv_sql('track_id')} % 40) / CAST(220 AS DOUBLE)) END, 6) AS x FROM tracks""", "tracks")
def j19(spark, sf):
    t = view(spark, sf, "tracks")
    swapped = t.select("track_id", C("y").alias("x"), C("x").alias("y"), "cluster").where("cluster < 8")
    return joins.coordinates(t.select("track_id"), t.where("cluster < 5"), swapped, fallback=S.hash_point(C("track_id"), 0.15, 40, 220.0)).select("track_id", F.round("x", 6).alias("x"))


@query("j20_playback_object", "SELECT track_id, CASE WHEN cluster = 1 THEN concat('o/', track_id) WHEN cluster = 2 THEN NULL ELSE concat('p/', track_id) END AS object_key FROM tracks", "tracks")
def j20(spark, sf):
    t = view(spark, sf, "tracks")
    preview = t.select("track_id", F.lit("preview").alias("kind"), F.when(C("cluster").isin(1, 2), " ").otherwise(F.concat(F.lit("p/"), "track_id")).alias("object_key"))
    original = t.select("track_id", F.lit("original").alias("kind"), F.when(C("cluster") != 2, F.concat(F.lit("o/"), "track_id")).alias("object_key"))
    return joins.playback_object(preview.union(original))


@query("s15_evidence_upsert", """
SELECT part_key, value FROM (SELECT l_partkey AS part_key, l_extendedprice AS value, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1""")
def s15(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr("l_partkey AS part_key", "l_extendedprice AS value", "l_orderkey * 10 + l_linenumber AS seq")
    return merges.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["part_key"], "seq").select("part_key", "value")


@query("e6_cache_todo", "SELECT stage_id FROM stages WHERE coalesce(cache_key, '') NOT IN (SELECT coalesce(cache_key, '-') FROM stages WHERE status IN ('succeeded', 'skipped'))", "stages")
def e6(spark, sf):
    s = view(spark, sf, "stages")
    return merges.cache_todo(s.select("stage_id", "cache_key"), s.select("cache_key", "status"), "retry").select("stage_id")


@query("e7_metadata_upsert", """
SELECT track_id, CASE WHEN cluster = 1 THEN 'New' WHEN cluster = 2 THEN '' ELSE title END AS title, CASE WHEN cluster = 1 THEN 99 ELSE bpm END AS bpm, CASE WHEN cluster = 2 THEN '1A' ELSE musical_key END AS musical_key FROM tracks""", "tracks")
def e7(spark, sf):
    t = view(spark, sf, "tracks").select("track_id", "title", "bpm", "musical_key")
    new = view(spark, sf, "tracks").where("cluster IN (1, 2)").select("track_id", F.when(C("cluster") == 1, "New").otherwise("").alias("title"), F.when(C("cluster") == 1, 99.0).alias("bpm"), F.when(C("cluster") == 2, "1A").otherwise("").alias("musical_key"))
    return merges.upsert_metadata(t, new, always=["title"])


FILL = "fill AS (SELECT track_id, CASE WHEN cluster < 5 THEN '9B' END AS new_key, CASE WHEN cluster < 5 THEN 125 END AS new_bpm FROM tracks)"


@query("m1_fill_missing", f"""
WITH {FILL} SELECT t.track_id, coalesce(nullif(musical_key, ''), new_key) AS musical_key, coalesce(bpm, new_bpm) AS bpm, CASE WHEN bpm IS NULL AND new_bpm IS NOT NULL THEN 'csv' END AS bpm_source FROM tracks t JOIN fill USING (track_id)""", "tracks")
def m1(spark, sf):
    t = view(spark, sf, "tracks")
    new = t.where("cluster < 5").select("track_id", F.lit("9B").alias("musical_key"), F.lit(125.0).alias("bpm"))
    filled = merges.fill_missing(t.select("track_id", "musical_key", "bpm"), new, "csv", stamped=["bpm"])
    return filled.select("track_id", F.nullif("musical_key", F.lit("")).alias("musical_key"), "bpm", "bpm_source")


@query("m2_source_records", "SELECT o_custkey AS track_id, o_orderpriority AS source_ref, min(o_orderkey) AS imported_at, max(o_orderkey) AS updated_at FROM orders GROUP BY ALL")
def m2(spark, sf):
    rows = view(spark, sf, "orders").selectExpr("o_custkey AS track_id", "o_orderpriority AS source_ref", "o_orderkey AS imported_at", "o_orderkey AS updated_at")
    return merges.retain_sources(rows.where("imported_at % 2 = 0"), rows.where("imported_at % 2 = 1"), ["track_id", "source_ref"])


@query("m3_conflicts", "SELECT track_id, coalesce(bpm <> 120, false) AS bpm_conflict, musical_key NOT IN ('', '8A') AS key_conflict FROM tracks", "tracks")
def m3(spark, sf):
    return view(spark, sf, "tracks").select("track_id", merges.bpm_conflict(C("bpm"), F.lit(120.01)).alias("bpm_conflict"), merges.key_conflict(C("musical_key"), F.lit("08a")).alias("key_conflict"))


@query("m4_libraries", "SELECT c_name AS name, c_mktsegment AS source, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, c_mktsegment, 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def m4(spark, sf):
    c = view(spark, sf, "customer").selectExpr("c_custkey", "c_name AS name", "c_mktsegment AS source")
    old = c.where("c_custkey % 2 = 0").select("name", "source", F.lit("old").alias("origin"))
    return merges.get_or_create(old, c.where("c_custkey % 3 = 0").select("name", "source", F.lit("new").alias("origin")), ["name", "source"])


@query("m5_tag_catalogue", "SELECT track_id, title, CASE WHEN artist = '' THEN 'Unknown artist' ELSE artist END AS artist FROM tracks WHERE cluster <> 6", "tracks")
def m5(spark, sf):
    return merges.tag_rows(view(spark, sf, "tracks").withColumn("object_key", F.when(C("cluster") != 6, C("location")))).select("track_id", "title", "artist")


@query("m6_precedence", """
SELECT track_id, CASE WHEN cluster = 1 THEN 'user' WHEN musical_key <> '' THEN musical_key ELSE 'estimate' END AS value FROM tracks""", "tracks")
def m6(spark, sf):
    t = view(spark, sf, "tracks")
    said = [t.where("cluster = 1").select("track_id", F.lit("user").alias("source"), F.lit("user").alias("value")), t.select("track_id", F.lit("tag").alias("source"), C("musical_key").alias("value")), t.select("track_id", F.lit("estimate").alias("source"), F.lit("estimate").alias("value"))]
    return merges.by_precedence(said[0].union(said[1]).union(said[2]), ["track_id"])


@query("m7_feature_map", "SELECT l_partkey AS track_id, count(DISTINCT l_suppkey) AS n, round(max(l_quantity), 4) AS top FROM lineitem GROUP BY l_partkey")
def m7(spark, sf):
    tall = view(spark, sf, "lineitem").groupBy(C("l_partkey").alias("track_id"), C("l_suppkey").cast("string").alias("feature_key")).agg(F.max("l_quantity").cast("double").alias("value"))
    wide = merges.feature_map(tall)
    return wide.select("track_id", F.map_size("features").cast("long").alias("n") if hasattr(F, "map_size") else F.size("features").cast("long").alias("n"), F.round(F.array_max(F.map_values("features")), 4).alias("top"))


@query("m8_crate_replay", """
WITH RECURSIVE own AS (SELECT user_id AS crate_id, event_id % 7 AS track_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'toggle' ELSE 'remove' END AS action FROM events WHERE event_type <> 'signup' OR event_id % 50 > 0),
e AS (SELECT * FROM own UNION ALL SELECT crate_id, track_id, seq, 'remove' FROM (SELECT DISTINCT crate_id, track_id FROM own) JOIN (SELECT event_id % 7 AS track_id, event_id AS seq FROM events WHERE event_type = 'signup' AND event_id % 50 = 0) USING (track_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY crate_id, track_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY crate_id, track_id) AS last FROM e),
walk AS (SELECT crate_id, track_id, i, last, action <> 'remove' AS held, CASE WHEN action <> 'remove' THEN seq END AS came FROM n WHERE i = 1
 UNION ALL SELECT n.crate_id, n.track_id, n.i, n.last, CASE n.action WHEN 'add' THEN true WHEN 'remove' THEN false ELSE NOT held END, CASE WHEN held AND n.action = 'add' THEN came WHEN n.action = 'remove' OR (held AND n.action = 'toggle') THEN NULL ELSE n.seq END FROM walk JOIN n ON n.crate_id = walk.crate_id AND n.track_id = walk.track_id AND n.i = walk.i + 1)
SELECT crate_id, track_id, (row_number() OVER (PARTITION BY crate_id ORDER BY came) - 1)::INT AS position FROM walk WHERE i = last AND held""")
def m8(spark, sf):
    everywhere = "event_type = 'signup' AND event_id % 50 = 0"
    e = view(spark, sf, "events").selectExpr("user_id AS crate_id", "event_id % 7 AS track_id", "event_id AS seq", f"CASE WHEN {everywhere} THEN 'remove_all' WHEN event_type = 'click' THEN 'add' WHEN event_type = 'view' THEN 'toggle' ELSE 'remove' END AS action")
    return merges.replay_crate(e).select("crate_id", "track_id", "position")


@query("u1_configurations", "SELECT configuration_id FROM (SELECT 'c1' AS configuration_id UNION SELECT configuration_id FROM judgments)", "judgments")
def u1(spark, sf):
    j = view(spark, sf, "judgments").select("configuration_id")
    return j.union(results(spark, sf).select("configuration_id")).distinct()


@query("u2_distinct_in_order", "SELECT event_id, concat(event_id % 3, ',', event_id % 3 + 1) AS ids FROM events")
def u2(spark, sf):
    n = C("event_id") % 3
    return view(spark, sf, "events").select("event_id", F.concat_ws(",", F.array_distinct(F.array(n, n + 1, n)).cast("array<string>")).alias("ids"))


@query("u3_unknown_candidates", "SELECT DISTINCT event_id % 900 AS candidate FROM events WHERE event_id % 900 NOT IN (SELECT vec_id FROM embeddings)")
def u3(spark, sf):
    pool = view(spark, sf, "events").select((C("event_id") % 900).alias("candidate")).distinct()
    return pool.join(view(spark, sf, "embeddings").select(C("vec_id").alias("candidate")), "candidate", "left_anti")
