"""Tags of audio files as a table, read from the files' heads.

``spark.read.format("tag_frames").load(folder)`` gives a row for each audio file below a folder: path, suffix, size,
tags (names in lower case) and error. Only the head of a file that holds tags is read, never its sound: ID3v2 (2.2 to
2.4: text frames and user-defined ones) and the comments of FLAC. Folders are any that ``pyarrow.fs`` can open: local
ones, or URIs of object stores and HDFS.

Partitions hold ``files_per_partition`` files (128) at most, whatever their folders.
With the option ``push_filters``, filters on path, suffix and size are decided on the listing, so files that they leave
out aren't opened. Spark allows it only where ``spark.sql.python.filterPushdown.enabled`` is set; ``load_tags`` follows that
setting. Elsewhere Spark applies all filters itself.

Defined results: a file without tags has an empty map; one that can't be read or whose tags are broken keeps its row, with
the tags before the break and ``error``; of repeated frames the first counts; files without an audio suffix are left
out; a folder without files gives an empty table; a folder that isn't there is an error.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from tracklens.functions import scalars as S

C = F.col
SCHEMA = "path string, suffix string, size long, tags map<string,string>, error string"
#: The text frames of ID3v2.3/2.4 and of 2.2 that have a name here.
FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TPUB": "publisher", "TBPM": "tbpm", "TKEY": "tkey", "TT2": "title", "TP1": "artist", "TAL": "album", "TCO": "genre", "TPB": "publisher", "TBP": "tbpm", "TKE": "tkey"}
#: How a text frame's first byte names its encoding.
ENCODINGS = ["latin-1", "utf-16", "utf-16-be", "utf-8"]
#: No tag is read beyond so many bytes; a larger one is an error of its file.
LARGEST = 64 << 20


class Broken(ValueError):
    """What is wrong with a file's tags."""


def _whole(data: bytes, n: int) -> bytes:
    if len(data) < n:
        raise Broken("tags end early")
    return data


def _sevens(data: bytes) -> int:
    """A number in the low seven bits of each byte."""
    if any(b > 127 for b in data):
        raise Broken("not a size of seven bits a byte")
    return sum(b << 7 * i for i, b in enumerate(reversed(data)))


def _texts(data: bytes) -> list[str]:
    """The zero-ended texts of a frame."""
    if not data:
        return [""]
    if data[0] >= len(ENCODINGS):
        raise Broken(f"encoding {data[0]}")
    return data[1:].decode(ENCODINGS[data[0]], "replace").replace("\ufeff", "").split("\0")


def id3_tags(head: bytes, body: bytes, tags: dict[str, str]) -> None:
    """Adds the tags of an ID3v2 header (10 bytes) and body."""
    version, flags = head[3], head[5]
    if version not in (2, 3, 4):
        raise Broken(f"version 2.{version}")
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at, name_size, header = 0, (3 if version == 2 else 4), (6 if version == 2 else 10)
    if flags & 0x40 and version > 2:
        size = _whole(body[:4], 4)
        at = _sevens(size) if version == 4 else 4 + int.from_bytes(size, "big")
    while at + header <= len(body) and body[at]:
        name, size = body[at : at + name_size].decode("latin-1"), body[at + name_size : at + 2 * name_size]
        n = _sevens(size) if version == 4 else int.from_bytes(size, "big")
        frame_flags = body[at + header - 1] if version > 2 else 0
        data = _whole(body[at + header : at + header + n], n)
        at += header + n
        if not name.startswith("T"):
            continue
        if frame_flags & (0x0C if version == 4 else 0xC0):  # compressed or encrypted
            continue
        if version == 4:
            data = data[4:] if frame_flags & 0x01 else data
            data = data.replace(b"\xff\x00", b"\xff") if (flags & 0x80 or frame_flags & 0x02) else data
        texts = _texts(data)
        if name in ("TXXX", "TXX"):
            tags.setdefault(texts[0].casefold(), texts[1].strip() if len(texts) > 1 else "")
        elif name in FRAMES:
            tags.setdefault(FRAMES[name], texts[0].strip())


def comment_tags(block: bytes, tags: dict[str, str]) -> None:
    """Adds the tags of a FLAC comment block: texts NAME=value, each after its length."""

    def text(at: int) -> tuple[bytes, int]:
        (n,) = struct.unpack("<I", _whole(block[at : at + 4], 4))
        return _whole(block[at + 4 : at + 4 + n], n), at + 4 + n

    _, at = text(0)
    (count,) = struct.unpack("<I", _whole(block[at : at + 4], 4))
    at += 4
    for _ in range(count):
        found, at = text(at)
        name, _, value = found.decode("utf-8", "replace").partition("=")
        tags.setdefault(name.casefold(), value.strip())


def read_tags(file, tags: dict[str, str]) -> None:
    """Adds the tags at the head of a seekable file."""
    head = file.read(10)
    if head[:3] == b"ID3":
        size = _sevens(_whole(head, 10)[6:])
        if size > LARGEST:
            raise Broken(f"tags of {size} bytes")
        body = file.read(size)
        id3_tags(head, body, tags)
        _whole(body, size)
    elif head[:4] == b"fLaC":
        at, last = 4, False
        while not last:
            file.seek(at)
            header = _whole(file.read(4), 4)
            last, size = header[0] > 127, int.from_bytes(header[1:], "big")
            if header[0] & 127 == 4:
                block = file.read(size)
                comment_tags(block, tags)
                _whole(block, size)
                return
            at += 4 + size


def opened(folder: str):
    """(file system, path) of a folder, which is local unless a URI."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri) else (fs.LocalFileSystem(), folder)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


#: What each filter that Spark pushes asks of a value.
TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
    IsNotNull: lambda x, v: True,
}
LISTED = ("path", "suffix", "size")


class TagReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.most = int(options.get("files_per_partition", 128))
        self.tests: list = []

    def partitions(self):
        from pyarrow import fs

        store, base = opened(self.folder)
        files = []
        for found in store.get_file_info(fs.FileSelector(base, recursive=True)):
            suffix = (re.findall(r"\.[^./]+$", found.path.lower()) or [""])[0]
            row = (found.path, suffix, found.size)
            if found.type == fs.FileType.File and suffix in S.AUDIO_SUFFIXES and all(TESTS[kind](row[at], value) for kind, at, value in self.tests):
                files.append(row)
        files.sort()
        return [Files(files[i : i + self.most]) for i in range(0, len(files), self.most)] or [Files([])]

    def read(self, partition):
        store, _ = opened(self.folder)
        for path, suffix, size in partition.files:
            tags: dict[str, str] = {}
            error = None
            try:
                with store.open_input_file(path) as file:
                    read_tags(file, tags)
            except (OSError, ValueError) as e:  # of this file alone
                error = f"{type(e).__name__}: {e}"
            yield path, suffix, size, tags, error


class FilteringTagReader(TagReader):
    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in LISTED and (value is not None or isinstance(f, IsNotNull)):
                self.tests.append((type(f), LISTED.index(f.attribute[0]), value))
            else:
                yield f


class TagFrames(DataSource):
    @classmethod
    def name(cls):
        return "tag_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        return (FilteringTagReader if options.get("push_filters", "").lower() == "true" else TagReader)(options)


def id3_head(tags: dict[str, str]) -> bytes:
    """An ID3v2.4 head with these tags; names without a frame of their own are user-defined ones."""
    sevens = lambda n: bytes(n >> 7 * i & 127 for i in (3, 2, 1, 0))
    frame_of = {name: frame for frame, name in FRAMES.items() if len(frame) == 4}
    body = b""
    for name, value in tags.items():
        text = b"\x03" + (value if name in frame_of else f"{name}\0{value}").encode()
        body += frame_of.get(name, "TXXX").encode() + sevens(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + sevens(len(body)) + body


def write_heads(files: DataFrame, folder: str) -> int:
    """Writes each row of (name, tags) as a file of that name that holds tags and no sound; says how many."""

    def write(batches):
        import pyarrow as pa

        store, base = opened(folder)
        store.create_dir(base)
        for batch in batches:
            for name, tags in zip(batch.column("name").to_pylist(), batch.column("tags").to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}") as file:
                    file.write(id3_head({k: v for k, v in tags if v is not None}))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("name", "tags").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_tags(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(path, suffix, size, tags, error) of the audio files below a folder."""
    spark.dataSource.register(TagFrames)
    options.setdefault("push_filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return spark.read.format("tag_frames").options(**options).load(folder)


def tag_metadata(files: DataFrame) -> DataFrame:
    """path, what a catalogue takes from tags, and status: found, or failed with its error."""
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(C("tags")[n]), F.lit("")) for n in names], F.lit(""))
    return files.select(
        "path",
        *[text(n).alias(n) for n in ("title", "artist", "album", "genre")],
        text("label", "publisher").alias("label"),
        S.tag_bpm(C("tags")).alias("bpm"),
        S.tag_key(C("tags")).alias("key"),
        F.when(C("error").isNull(), "found").otherwise("failed").alias("status"),
        "error",
    )
