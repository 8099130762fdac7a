"""The text index finds what a scan finds, and reads only the postings asked for."""

import pytest

from tracklens.operators.text_index import BUCKETS, TextIndex, grams_of, page, searched
from pyspark.sql import functions as F

SCHEMA = "track_id string, title string, artist string, created_at long"


@pytest.fixture(scope="module")
def tracks(spark):
    titles = ["Night Drive", "night driver", "Überfall", "Ωmega 7", "100% %_x", "aaaaaa", "a", "", None, "日本の夜", "Nightfall"]
    artists = ["Ann", "The Night", None, "", "Ünder", "aab", "Artist 1", "Artist 12"]
    rows = [(f"t{i:03}", titles[i % len(titles)], artists[i % len(artists)], i // 7) for i in range(400)]
    return spark.createDataFrame([*rows, (None, "Night", "x", 1)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def index(tracks, tmp_path_factory):
    return TextIndex.build(tracks, str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("said", ["night", " NIGHT d", "drive ann", "über", "ü", "", "aaa", "aaaaaaa", "% %_", "日本の", "artist 1", "artist 12", "absent words", "night absent", "7 the night"])
def test_search_equals_the_scan(tracks, index, said):
    every = searched(tracks).where(F.contains("text", F.lit(said.strip().lower())))
    for offset, limit in ((0, 50), (3, 5), (1000, 5)):
        want = [(r.track_id, r.created_at) for r in page(every, offset, limit).collect()]
        assert [tuple(r) for r in index.search(said, offset, limit).collect()] == want


def test_only_the_postings_asked_for_are_read(index):
    met = index._of("postings", grams_of("night d"))
    files = {f.split("bucket=")[1].split("/")[0] for f in (r[0] for r in met.select(F.input_file_name()).distinct().collect())}
    assert 0 < len(files) <= len(grams_of("night d")) < BUCKETS
    plan = index.search("night d")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "gram#" in line]
    assert scans and all("PartitionFilters: [bucket" in s and "PushedFilters: [In(gram" in s for s in scans)
    assert "TakeOrderedAndProject" in plan and "Sort [" not in plan


def test_tracks_are_added_once(spark, tracks, tmp_path):
    index = TextIndex.build(tracks.where("track_id < 't200'"), str(tmp_path / "i"))
    index.append(tracks.where("track_id >= 't200'"))
    whole = [(r.track_id, r.created_at) for r in page(searched(tracks).where(F.contains("text", F.lit("night"))), 0, 400).collect()]
    assert [tuple(r) for r in index.search("night", 0, 400).collect()] == whole
    with pytest.raises(ValueError):
        index.append(tracks.where("track_id = 't003'"))
