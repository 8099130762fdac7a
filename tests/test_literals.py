"""Small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.operators import aggregates, evaluation, evidence, filters, joins, merges, projection, ranking, recommend, similarity, validate
from tracklens.sources import catalogue, sinks

C = F.col


def one(spark, column, **values):
    kinds = ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column.alias("c")).first().c


def vectors(spark, rows, model="m"):
    return spark.createDataFrame([(i, model, [float(x) for x in v]) for i, v in rows], "track_id string, model string, embedding array<float>")


def test_knn_ties_go_to_the_smaller_id(spark):
    v = vectors(spark, [("a", [1, 0]), ("b", [1, 0]), ("c", [1, 0]), ("d", [0, 1])])
    got = similarity.knn(v, 2, zscore=False).collect()
    assert len(got) == 8
    assert [(r.target, round(r.score, 9), round(r.distance, 9)) for r in sorted(got, key=lambda r: r.rank) if r.source == "a"] == [("b", 1.0, 0.0), ("c", 1.0, 0.0)]


def test_knn_standardizes(spark):
    v = vectors(spark, [("a", [1000, 1, 5]), ("b", [1000, 2, 5]), ("c", [1000, 10, 5]), ("d", [1000, 11, 5])])
    stats = aggregates.dimension_stats(v).collect()
    assert sum(r.sd == 0 for r in stats) == 2
    best = [r for r in similarity.knn(v, 1).collect() if r.source == "a"]
    assert [(r.target, round(r.score, 9)) for r in best] == [("b", 1.0)]


def test_knn_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 10)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(45, 6))
    v = vectors(spark, [(f"t{i:03}", row) for i, row in enumerate(x)])
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    score = u @ u.T
    np.fill_diagonal(score, -9)
    want = {(f"t{i:03}", f"t{j:03}") for i in range(45) for j in np.argsort(-score[i])[:4]}
    assert {(r.source, r.target) for r in similarity.knn(v, 4, zscore=False).collect()} == want


@pytest.mark.parametrize("rows", [[("a", [0, 0]), ("b", [1, 1])], [("a", [math.nan, 1]), ("b", [1, 1])], [("a", [math.inf, 1]), ("b", [1, 1])], [("a", [1, 1]), ("a", [2, 2])], [("a", [1]), ("b", [1, 1])], []])
def test_unusable_corpora_are_refused(spark, rows):
    with pytest.raises(ValueError):
        similarity.knn(vectors(spark, rows), 1, zscore=False)


def test_a_vector_at_the_mean_has_no_direction(spark):
    with pytest.raises(ValueError):
        similarity.knn(vectors(spark, [("a", [1, 1]), ("b", [2, 2]), ("c", [3, 3]), ("d", [2, 2])]), 1)


def test_seed_ranking(spark):
    v = vectors(spark, [("a", [1, 0, 0]), ("b", [0.9, 0.1, 0]), ("c", [0, 1, 0]), ("z", [0, 0, 0])])
    assert [r.track_id for r in similarity.rank_for_seed(v, "a", zscore=False).collect()] == ["b", "c"]


def test_approximate_recall(spark):
    rng = np.random.default_rng(2)
    v = vectors(spark, [(f"t{i:03}", row) for i, row in enumerate(rng.normal(size=(200, 8)))])
    exact = {(r.source, r.target) for r in similarity.knn(v, 5).collect()}
    near = {(r.source, r.target) for r in similarity.approximate_pairs(v, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize(("bpms", "want"), [([], (108, 136)), ([108.0, 150.0, None], (108, 150)), ([122.0], (121, 123)), ([120.6, 130.4], (120, 131)), ([math.nan, 1.0], (1, 2))])
def test_bpm_bounds(spark, bpms, want):
    assert tuple(aggregates.bpm_bounds(spark.createDataFrame([(b,) for b in bpms], "bpm double")).first()) == want


def test_identity_join_cases(spark):
    ident = lambda df: df.withColumn("t", S.identity_part(C("title"))).withColumn("a", S.identity_part(C("artist")))
    tracks = spark.createDataFrame([("1", "Sunday Sunset", "Josh Butler, SOHMI"), ("2", "Duplicate", "X"), ("3", "Duplicate", "X")], "track_id string, title string, artist string")
    rows = spark.createDataFrame([("r1", "Sunday Sunset!", "JOSH BUTLER, SOHMI"), ("r2", "Duplicate", "X"), ("r3", "Missing", "Y")], "row string, title string, artist string")
    got = {r.row: (r.status, r.matched_track_id) for r in joins.unique_identity_join(ident(tracks), ident(rows), ["t", "a"]).collect()}
    assert got == {"r1": ("matched", "1"), "r2": ("ambiguous", None), "r3": ("unmatched", None)}


def test_closed_join_refuses_gaps(spark):
    left, right = spark.range(3), spark.range(2)
    with pytest.raises(ValueError):
        joins.closed_join(left, right, "id")
    assert joins.closed_join(right, left, "id").count() == 2


def test_keys_and_merges(spark):
    assert one(spark, S.canonical_key(C("k")), k=" 04a ") == "4A"
    assert one(spark, S.canonical_key(C("k")), k="13A") == "13A"
    assert one(spark, S.key_neighbours(C("k")), k="12A") == ["11A", "1A", "12B"]
    assert one(spark, merges.key_conflict(F.lit("04A"), F.lit("4A"))) is False
    old = spark.createDataFrame([("1", "04A", "", None)], "track_id string, musical_key string, album string, bpm double")
    new = spark.createDataFrame([("1", "9B", "Nights", 122.0)], "track_id string, musical_key string, album string, bpm double")
    assert merges.fill_missing(old, new, "csv", ["bpm", "musical_key"]).first().asDict() == {"track_id": "1", "musical_key": "04A", "album": "Nights", "bpm": 122.0, "bpm_source": "csv", "musical_key_source": None}


def test_unicode_identity(spark):
    rows = spark.createDataFrame([("GOING BACK TO CALI ㋡",), ("Beyoncé",), ("東京",), (None,)], "x string")
    assert [r.c for r in rows.select(S.identity_unicode()("x").alias("c")).collect()] == ["goingbacktocali", "beyonce", "東京", ""]


def test_tags(spark):
    import base64

    coded = base64.b64encode(b'{"key":"8A","x":1}').decode().rstrip("=")
    tags = spark.createDataFrame([({"bpm": "0", "tbpm": "126.5", "initialkey": coded},), ({"bpm": "x", "key": " 4A "},), ({"initialkey": "a text that is far too long", "key": "5B"},)], "tags map<string,string>")
    assert [tuple(r) for r in tags.select(S.tag_bpm(C("tags")), S.tag_key(C("tags"))).collect()] == [(126.5, "8A"), (None, "4A"), (None, "5B")]


def test_scores_and_prompts(spark):
    assert [one(spark, S.clamp_score(F.lit(x).cast("double"))) for x in (0.8, 1.4, None, float("nan"), -1.0)] == [0.8, 1.0, 0.5, 0.5, 0.0]
    f = S.prompt_filters(F.lit("Darker peak around 300"), F.lit(108), F.lit(136))
    assert one(spark, f["bpm_min"]) == 136 and one(spark, f["moods"]) == ["dark"] and one(spark, f["energies"]) == ["peak", "driving"]


def test_candidate_order(spark):
    t = spark.createDataFrame([("slow", 110.0), ("warm", 122.0), ("peak", 128.0), ("seed", 122.0)], "track_id string, bpm double").withColumns({"title": C("track_id"), "analysis_status": F.lit("ok"), "hidden": F.lit(False)})
    none = t.where("false")
    got = recommend.pick_candidates(t, "around 122 BPM", t.where("track_id = 'slow'"), none, "seed", limit=3)
    assert [r.track_id for r in got.collect()] == ["warm", "peak", "slow"]
    assert [r.track_id for r in recommend.pick_candidates(t.where("track_id = 'seed'"), "x", none, none, "seed").collect()] == ["seed"]


def test_metrics_of_one_judgment(spark):
    j = spark.createDataFrame([(1, "c", "overall", "similar", 1, 4), (2, "c", "drums", "skip", None, None)], "judgment_id int, configuration_id string, dimension string, judgment string, rank_position int, ordinal_rating int")
    assert [(r.dimension, r.value, r.sample_count) for r in evaluation.accepted_at_k(j).collect()] == [("overall", 1.0, 1)]
    assert [r.value for r in evaluation.ndcg(j).collect()] == [1.0]
    zero = j.withColumn("ordinal_rating", F.lit(0)).where("rank_position IS NOT NULL")
    assert [r.value for r in evaluation.ndcg(zero).collect()] == [0.0]
    m = spark.createDataFrame([("c", "overall", "ndcg", 1.0, 1), ("c", "overall", "runtime", 2.0, 4)], "configuration_id string, dimension string, metric_name string, value double, sample_count int")
    assert evaluation.configuration_report(m, ["ndcg", "runtime"]).first().judgment_count == 4


def test_windows(spark):
    plans = spark.createDataFrame(evidence.PLANS, evidence.PLAN)
    audio = spark.createDataFrame([("long", 36_000, 100), ("short", 500, 100), ("none", 0, 100)], "track_id string, frames long, rate int")
    got = {}
    for r in evidence.expand_windows(audio, plans).orderBy("index").collect():
        got.setdefault((r.track_id, r.version), []).append((r.start, r.end))
    assert got["long", "sampled-v1"] == [(0, 1000), (17500, 18500), (35000, 36000)]
    assert got["long", "full-overlap-v1"][:2] == [(0, 1000), (500, 1500)] and got["long", "full-overlap-v1"][-1] == (35000, 36000)
    assert got["long", "legacy-librosa-v1"] == [(12000, 24000)]
    assert all(got["short", p[0]] == [(0, 500)] for p in evidence.PLANS) and not any(t == "none" for t, _ in got)
    assert evidence.plan_errors(plans).count() == 0


def test_neighbourhood(spark):
    t = spark.createDataFrame([("a", 0, "Warm Rollers", 0.0, 0.0), ("b", 0, "Warm Rollers", 0.0, 0.0), ("c", 1, "Afterhours Deep", 3.0, 0.0), ("d", 2, "Far", 9.0, 9.0)], "track_id string, cluster int, cluster_name string, x double, y double")
    r = projection.neighbourhoods(t).where("track_id = 'a'").first()
    assert (r.home, r.shared, r.lean) == ("Warm Rollers", 2, "Afterhours Deep")


def test_genre_layout(spark):
    rows = [(f"{g}{i}", "L", name, float(i % 4) / 4, float(g)) for g, name in enumerate(["Nu-Disco", "Nu Disco", "Techno", "House", "Ambient", "Minimal"]) for i in range(12)]
    points = spark.createDataFrame(rows, "track_id string, library_id string, genre string, x double, y double")
    laid = projection.lay_out(points)
    assert laid.select("cluster").distinct().count() == 5 and laid.count() == 72
    islands = projection.pack_islands(projection.genre_islands(points)[0]).collect()
    for i, a in enumerate(islands):
        for b in islands[:i]:
            assert math.hypot(a.x - b.x, a.y - b.y) > a.radius + b.radius


def test_pca_map(spark):
    v = vectors(spark, [("x", [2, 0, 0]), ("y", [0, 2, 0]), ("z", [0, 0, 0])])
    got = {r.track_id: (r.x, r.y) for r in projection.pca_map(v.select("track_id", "embedding")).collect()}
    assert math.hypot(*got["x"]) > 0.1 and math.hypot(*got["y"]) > 0.1
    assert tuple(projection.pca_map(v.where("track_id = 'x'").select("track_id", "embedding")).first()) == ("x", 0.0, 0.0)


def test_reduced_vectors(spark):
    rng = np.random.default_rng(5)
    v = vectors(spark, [(str(i), row) for i, row in enumerate(rng.normal(size=(20, 16)))]).select("track_id", "embedding")
    got = np.array([r.embedding for r in projection.reduce_vectors(v, 6).collect()])
    assert got.shape == (20, 6) and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-6)


def test_neighbour_order(spark):
    t = spark.createDataFrame([("near", False), ("far", False), ("hid", True)], "track_id string, hidden boolean")
    n = spark.createDataFrame([("s", "far", 1), ("s", "hid", 2), ("s", "near", 3)], "source string, track_id string, rank int")
    assert [r.track_id for r in joins.order_by_neighbours(t, n).orderBy("rank").collect()] == ["far", "near"]


def test_studio_filter_passes_missing_bpm_only_without_a_limit(spark):
    t = spark.createDataFrame([("a", None)], "track_id string, bpm double")
    assert t.where(filters.studio_predicate(filters.StudioFilter())).count() == 1
    assert t.where(filters.studio_predicate(filters.StudioFilter(bpm=(110, 136)))).count() == 0


def test_percentile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (math.nan,)], "v double")
    assert sorted(r.pct for r in ranking.strict_percentile(df, "v").collect()) == [0.0, pytest.approx(1 / 3), pytest.approx(1 / 3), 0.5, 0.5]


def test_files(spark, tmp_path):
    (tmp_path / "lib.xml").write_text('<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION><TRACK TrackID="1" Name="Sunset Line" Artist="Ada" AverageBpm="122.00" Rating="153" Location="file://localhost/Music/a%20b+c.wav"/></COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="Sets"><NODE Type="1" Name="Warm Up"><TRACK Key="1"/></NODE></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>')
    (r,) = catalogue.load_xml(spark, str(tmp_path / "lib.xml")).collect()
    assert (r.title, r.bpm, r.rating, r.location, r.album) == ("Sunset Line", 122.0, 3, "/Music/a b+c.wav", "")
    files = spark.createDataFrame([("f", (tmp_path / "lib.xml").read_text())], "file string, xml string")
    assert [tuple(r) for r in catalogue.playlists(files).collect()] == [("f", "Sets/Warm Up", 0, "1")]
    (tmp_path / "bad.csv").write_text("track_id,title\n1,x\n")
    with pytest.raises(ValueError, match="artist"):
        catalogue.load_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "bom.csv").write_text("﻿track_id,title,artist,bpm,rating\n1, Sunset ,Ada,x,4.9\n", encoding="utf-8")
    (r,) = catalogue.load_csv(spark, str(tmp_path / "bom.csv")).collect()
    assert (r.track_id, r.title, r.bpm, r.rating) == ("1", "Sunset", None, 4)


def test_torn_lines(spark, tmp_path):
    read = lambda name: catalogue.load_jsonl(spark, str(tmp_path / name), "k string, n int", ["k"], "n")
    (tmp_path / "torn.jsonl").write_text('{"k":"a","n":1}\n{"k":"a","n":2}\n{"k":"b"')
    assert [tuple(r) for r in read("torn.jsonl").collect()] == [("a", 2)]
    (tmp_path / "broken.jsonl").write_text('{"k":"a","n":1}\n{"k":\n{"k":"b","n":3}\n')
    with pytest.raises(ValueError):
        read("broken.jsonl")


def test_exports(spark):
    import xml.etree.ElementTree as ET

    t = spark.createDataFrame([("1001", "Sunset & Line", "Ada", 122.0, 360.0, "/m/sunset line.wav", "8A", "House")], "track_id string, title string, artist string, bpm double, duration_sec double, location string, key string, genre string")
    items = spark.createDataFrame([("Warm Up", 0, "1001"), ("Warm Up", 1, "gone")], "crate string, position int, track_id string")
    lines = [r.text for r in sinks.m3u_lines(items, t).orderBy("line").collect()]
    assert lines == ["#EXTM3U", "#PLAYLIST:Warm Up", "#EXTINF:360,Ada - Sunset & Line", "/m/sunset line.wav"]
    row = sinks.csv_rows(items, t).first()
    assert list(row.asDict()) == sinks.EXPORT and row.album == "" and row.bpm == "122.0"
    assigned = spark.createDataFrame([("1001", 0, "deep", "Peak time", 0)], "track_id string, cluster int, cluster_name string, moment string, position int")
    text = "\n".join(r.text for r in sinks.collection_lines("x", t, items, assigned, "Tracklens").orderBy("section", "major", "minor").collect())
    root = ET.fromstring(text.encode())
    assert [n.get("TrackID") for n in root.find("COLLECTION")] == ["1001"]
    assert [n.get("Name") for n in root.iter("NODE")] == ["ROOT", "Tracklens — crates", "Warm Up", "Tracklens — clusters", "0 · deep", "Tracklens — moments", "Peak time"]
    assert root.find("COLLECTION/TRACK").get("Location") == "file://localhost/m/sunset%20line.wav"


def test_extraction_isolates_failures(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.5] * 50, 100), (2, [], 100), (3, [0.0] * 10, 100)], "id int, samples array<double>, rate int")
    got = {r.id: r for r in evidence.extract(rows, [("signal", "1", evidence.signal_features)], "id").collect()}
    assert got[1].status == "ok" and got[1].features["rms"] == 0.5 and got[1].features["duration_sec"] == 1.0
    assert got[2].status == "failed" and got[2].attempts == 2 and "finite" in got[2].error
    assert got[3].status == "ok" and got[3].features["crest"] == 0.0


def test_registry_rules():
    r = evidence.ExtractorRegistry()
    r.register("a", "1", dict)
    r.register("a", "2", dict)
    with pytest.raises(LookupError):
        r.resolve("a")
    with pytest.raises(LookupError):
        r.plan([("b", None, True)])
    assert r.plan([("a", "1", True), ("b", None, False)])[1] == ["b"]


def test_checks(spark):
    t = spark.createDataFrame([(1, "x"), (2, None)], "id int, kind string")
    assert [tuple(r) for r in validate.violations(t, "id", {"kind": C("kind").isin("x")}).collect()] == [("2", "kind")]
    with pytest.raises(ValueError):
        validate.require_none(validate.not_unique(t.union(t), ["id"]), "ids repeat")
    validate.require_none(validate.orphans(t, t, "id"), "orphans")


def test_solo_cluster(spark):
    a = spark.createDataFrame([("t", 0, "deep", "Peak time")], "track_id string, cluster int, cluster_name string, moment string")
    assert aggregates.cluster_summary(a, "r").first().name == "solo"
    assert aggregates.cluster_summary(a.where("false"), "r").count() == 0


def test_rounding_goes_by_the_exact_value(spark):
    """0.50345 lies below the half, 0.50355 above; 0.03125 and 0.09375 are halves, which go to the even digit."""
    from pyspark.sql import functions as F

    from tracklens.functions.scalars import exact_round

    rng = np.random.default_rng(6)
    values = [0.50345, 0.50355, 0.03125, 0.09375, 0.28125, 2.5, 1e-300, 5e-5, 4.9999e-5, 0.0, -0.50345, -0.03125, 12345.67895, 1.00005, 0.99995, 0.99999999, None]
    values += (rng.integers(0, 10**5, 400) / 1e5).tolist() + (rng.integers(0, 2**12, 200) / 2**12).tolist() + rng.normal(0, 100, 200).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[exact_round(F.col("v"), p).alias(f"p{p}") for p in (2, 4, 5)]).collect()
    for r in rows:
        for p in (2, 4, 5):
            assert r[f"p{p}"] == (None if r.v is None else round(r.v, p)), (r.v, p)
    odd = spark.createDataFrame([(float("inf"),), (1e300,)], "v double").select(exact_round(F.col("v"), 4).alias("r")).collect()
    assert [r.r for r in odd] == [float("inf"), 1e300]


def test_removals_from_all_crates_are_not_multiplied_by_crates(spark):
    """4 crates, 50 removals from all of them: a replay adds no rows to the edits; those at a removal's seq go first."""
    own = [(c, "t", 2 * i, "toggle" if i % 3 else "add") for c in "abcd" for i in range(50)]
    rows = [*own, *[(None, "t", 2 * i + 1, "remove_all") for i in range(49)], ("a", "t", 99, "remove_all"), ("b", "t", 99, "add"), ("c", "t", 100, "add"), ("c", "u", 5, "add"), ("d", "t", 101, "toggle"), ("d", "t", 102, "toggle"), ("d", "v", 1, "add")]
    edits = spark.createDataFrame(rows, "crate_id string, track_id string, seq long, action string")
    df = merges.replay_crate(edits)
    assert sorted(map(tuple, df.collect())) == [("c", "t", 1), ("c", "u", 0), ("d", "v", 0)]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
