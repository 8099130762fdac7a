"""Tags read from files' heads: every version, broken files, filters on the listing."""

import struct

import pytest

from tracklens.sources.tag_frames import EqualTo, FilteringTagReader, GreaterThan, In, StringContains, TagReader, id3_head, load_tags, tag_metadata


def sevens(n):
    return bytes(n >> 7 * i & 127 for i in (3, 2, 1, 0))


def id3(version, frames, flags=0, extended=b""):
    """A head of (name, data[, frame flags]) by the format's definition."""
    body = extended
    for name, data, *more in frames:
        if version == 2:
            body += name.encode() + len(data).to_bytes(3, "big") + data
        else:
            body += name.encode() + (sevens(len(data)) if version == 4 else len(data).to_bytes(4, "big")) + bytes([0, *(more or [0])]) + data
    return b"ID3" + bytes([version, 0, flags]) + sevens(len(body)) + body


def flac(*comments):
    texts = [b"maker", *[c.encode() for c in comments]]
    parts = [struct.pack("<I", len(t)) + t for t in texts]
    block = parts[0] + struct.pack("<I", len(comments)) + b"".join(parts[1:])
    return b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + bytes(34) + b"\x84" + len(block).to_bytes(3, "big") + block


LONG = "x" * 300
FILES = {
    "a/two.mp3": id3(2, [("TT2", b"\0Caf\xe9"), ("TBP", b"\x00128"), ("TXX", b"\0InitialKey\x008A")]) + bytes(50) + b"sound",
    "a/three.mp3": id3(3, [("TIT2", b"\x01" + "Ünder".encode("utf-16")), ("APIC", b"\0" * 400), ("TXXX", b"\x01" + "LABEL\0".encode("utf-16") + "One".encode("utf-16")), ("TPUB", b"\0Two")]) + bytes(9),
    "a/four.AIFF": id3(4, [("TIT2", b"\x03" + LONG.encode()), ("TPE1", b"\x03First\0Second"), ("TIT2", b"\x03again"), ("TCON", b"\x02" + "Hôuse".encode("utf-16-be"))]),
    "b/extended.mp3": id3(4, [("TKEY", b"\x03Am")], 0x40, sevens(6) + b"\x01\0"),
    "b/extended3.mp3": id3(3, [("TKEY", b"\0Bm")], 0x40, (6).to_bytes(4, "big") + bytes(6)),
    "b/unsynced.mp3": id3(4, [("TIT2", b"\x00\xff\x00a", 0x02), ("TPE1", b"\0\0\0\x02\0b", 0x01), ("TALB", b"\0packed", 0x08)]),
    "b/song.flac": flac("TITLE= Öne ", "Artist=A=B", "BPM=0", "tbpm=99.5", "KEY=eyJrZXkiOiAiNEEifQ"),
    "c/none.wav": b"RIFF",
    "c/empty.mp3": b"",
    "c/short.mp3": id3(4, [("TIT2", b"\x03Kept"), ("TPE1", b"\x03" + LONG.encode())])[:60],
    "c/encoding.mp3": id3(4, [("TIT2", b"\x09odd")]),
    "c/version.mp3": id3(9, []),
    "c/cut.flac": flac("TITLE=One", "ARTIST=Two")[:-3],
    "c/huge.mp3": b"ID3\x04\0\0\x7f\x7f\x7f\x7f",
    "c/notes.txt": id3_head({"title": "not audio"}),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("tags")
    for name, data in FILES.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(data)
    return base


def test_every_version_and_broken_files(spark, folder):
    df = load_tags(spark, f"file://{folder}", files_per_partition=4)
    assert df.rdd.getNumPartitions() == 4
    rows = {r.path.removeprefix(f"{folder}/"): r for r in df.collect()}
    assert set(rows) == set(FILES) - {"c/notes.txt"}
    tags = {n: r.tags for n, r in rows.items()}
    assert tags["a/two.mp3"] == {"title": "Café", "tbpm": "128", "initialkey": "8A"}
    assert tags["a/three.mp3"] == {"title": "Ünder", "label": "One", "publisher": "Two"}
    assert tags["a/four.AIFF"] == {"title": LONG, "artist": "First", "genre": "Hôuse"}
    assert tags["b/extended.mp3"] == {"tkey": "Am"} and tags["b/extended3.mp3"] == {"tkey": "Bm"}
    assert tags["b/unsynced.mp3"] == {"title": "ÿa", "artist": "b"}
    assert tags["b/song.flac"] == {"title": "Öne", "artist": "A=B", "bpm": "0", "tbpm": "99.5", "key": "eyJrZXkiOiAiNEEifQ"}
    assert tags["c/none.wav"] == {} and tags["c/empty.mp3"] == {}
    assert tags["c/short.mp3"] == {"title": "Kept"} and tags["c/cut.flac"] == {"title": "One"}
    broken = {n for n, r in rows.items() if r.error is not None}
    assert broken == {f"c/{n}" for n in ("short.mp3", "encoding.mp3", "version.mp3", "cut.flac", "huge.mp3")}
    assert rows["a/four.AIFF"].suffix == ".aiff" and rows["a/two.mp3"].size == len(FILES["a/two.mp3"])


def test_metadata(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in tag_metadata(load_tags(spark, str(folder))).collect()}
    assert (rows["song.flac"].bpm, rows["song.flac"].key, rows["song.flac"].title) == (99.5, "4A", "Öne")
    assert rows["three.mp3"].label == "One" and rows["two.mp3"].bpm == 128 and rows["two.mp3"].key == "8A"
    assert (rows["none.wav"].title, rows["none.wav"].bpm, rows["none.wav"].key, rows["none.wav"].status) == ("", None, None, "found")
    assert rows["short.mp3"].status == "failed" and rows["short.mp3"].title == "Kept"


def test_filters_are_decided_on_the_listing(folder):
    reader = FilteringTagReader({"path": str(folder)})
    left = list(reader.pushFilters([In(("suffix",), (".flac", ".wav")), GreaterThan(("size",), 4), StringContains(("error",), "x"), EqualTo(("tags", "a"), "b")]))
    assert left == [StringContains(("error",), "x"), EqualTo(("tags", "a"), "b")]
    assert [f[0].removeprefix(f"{folder}/") for p in reader.partitions() for f in p.files] == ["b/song.flac", "c/cut.flac"]


def test_pushed_by_spark(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        df = load_tags(spark, str(folder), files_per_partition=1).where("suffix = '.flac' AND size > 3 AND error IS NULL")
        assert df.rdd.getNumPartitions() == 2  # of both FLAC files; no other is opened
        assert [r.tags["artist"] for r in df.collect()] == ["A=B"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_files_and_no_folder(spark, folder, tmp_path):
    assert load_tags(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="(?i)not exist|no such|cannot"):
        load_tags(spark, str(tmp_path / "missing")).count()


def test_heads_written_are_read_back(tmp_path):
    tags = {"title": "Ö", "tbpm": "120", "mood": "calm\n", "empty": ""}
    (tmp_path / "x.mp3").write_bytes(id3_head(tags) + b"sound")
    reader = TagReader({"path": str(tmp_path)})
    ((_, _, _, found, error),) = reader.read(reader.partitions()[0])
    assert found == {"title": "Ö", "tbpm": "120", "mood": "calm", "empty": ""} and error is None
