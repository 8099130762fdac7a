"""Catalogue sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions import scalars as S

C = F.col


def resolve_lookups(rows: DataFrame, **lookups: DataFrame) -> DataFrame:
    """rows with the name behind each <lookup>_id, the canonical device path, and tempo in beats (it comes in hundredths).

    A lookup has a row for each artist, album, genre, label or key of one device; the planner broadcasts it
    where its size allows.
    """
    for name, names in lookups.items():
        rows = rows.join(names.select(C("id").alias(f"{name}_id"), C("name").alias(name)), f"{name}_id", "left")
    return rows.withColumn("path", S.device_path()(C("location"))).withColumn("tempo", C("tempo") / 100)


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix, size, modified, content_hash, status) of all files below a folder.

    Files that aren't audio stay in the result as unsupported.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", suffix.alias("suffix"), C("length").alias("size"), C("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash")).withColumn("status", F.when(C("suffix").isin(S.AUDIO_SUFFIXES), "found").otherwise("unsupported"))


CSV_TEXT = ["track_id", "title", "artist", "album", "genre", "label", "key", "location", "date_added"]
CSV_NUMBERS = {"bpm": "double", "duration_sec": "double", "rating": "int"}


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A library's CSV. track_id, title and artist must be there; other columns may be missing; bad numbers are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {"track_id", "title", "artist"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    have = lambda c: F.coalesce(F.trim(C(c)), F.lit("")) if c in raw.columns else F.lit("")
    number = lambda c, kind: have(c).try_cast("double") if kind == "double" else have(c).try_cast("double").cast(kind)
    return raw.select(*[have(c).alias(c) for c in CSV_TEXT], *[number(c, kind).alias(c) for c, kind in CSV_NUMBERS.items()])


XML_TRACK = "_TrackID string, _Name string, _Artist string, _Album string, _Genre string, _Label string, _AverageBpm string, _Tonality string, _TotalTime string, _Rating string, _DateAdded string, _Location string"


def load_xml(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a collection's XML; playlists' TRACK nodes, which have no id, are left out."""
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(XML_TRACK).load(path).where("_TrackID IS NOT NULL")
    place = S.text(C("_Location"))
    decoded = F.try_url_decode(F.replace(F.substring(place, F.lit(8), F.length(place)), F.lit("+"), F.lit("%2B")))
    local = F.when(place.startswith("file://"), F.regexp_replace(decoded, "^localhost", "")).otherwise(place)
    rating = F.coalesce(F.bround(C("_Rating").try_cast("double") / 51, 0).cast("int"), F.lit(0))
    names = {"title": "_Name", "artist": "_Artist", "album": "_Album", "genre": "_Genre", "label": "_Label", "key": "_Tonality", "date_added": "_DateAdded"}
    return raw.select(C("_TrackID").alias("track_id"), *[S.text(C(c)).alias(n) for n, c in names.items()], C("_AverageBpm").try_cast("double").alias("bpm"), C("_TotalTime").try_cast("double").alias("duration_sec"), local.alias("location"), rating.alias("rating"))


def playlists(files: DataFrame) -> DataFrame:
    """(file, crate, position, track_id) of (file, xml): leaves of the playlist tree under their folders' names.

    A row is a file; Spark deals files to tasks. The tree has no fixed depth, so no schema fits it.
    """

    def parse(batches):
        import xml.etree.ElementTree as ET

        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["xml"], strict=True):
                todo = [(node, "") for node in ET.fromstring(text).findall("PLAYLISTS/NODE")[:1]]
                while todo:
                    node, above = todo.pop()
                    name = node.get("Name", "")
                    if node.get("Type") == "1":
                        rows += [(file, above + name, i, t.get("Key", "")) for i, t in enumerate(node.findall("TRACK"))]
                    else:
                        below = f"{above}{name}/" if name and name.upper() != "ROOT" else ""
                        todo += [(child, below) for child in reversed(node.findall("NODE"))]
            yield pd.DataFrame(rows, columns=["file", "crate", "position", "track_id"])

    return files.select("file", "xml").mapInPandas(parse, "file string, crate string, position int, track_id string")


def load_jsonl(spark: SparkSession, path: str, schema: str, keys: list[str], sequence: str) -> DataFrame:
    """The newest row of each key. A file's last line may be torn; a broken line elsewhere is an error."""
    from tracklens.operators.ranking import latest

    raw = spark.read.text(path).select("value", C("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    lines = raw.withColumn("at", F.monotonically_increasing_id())
    read = lines.withColumn("row", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    last = read.groupBy("file").agg(F.max("at").alias("last"))
    inside = read.where("row._broken IS NOT NULL").join(last, "file").where("at < last").limit(1)
    if not inside.isEmpty():
        raise ValueError(f"broken line inside {inside.first().file}")
    whole = read.where("row._broken IS NULL").select("row.*").drop("_broken")
    return latest(whole, keys, [sequence])


def decode_vectors():
    """Column function: float32 little-endian bytes to an array; null if they aren't whole values."""
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return decode


def encode_vectors():
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        import numpy as np

        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode
