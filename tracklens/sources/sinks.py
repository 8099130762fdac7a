"""Sinks: snapshots, replaced partitions, and exports of crates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.sources.shared import staged

C = F.col
# The columns of a CSV export.
EXPORT = ["track_id", "title", "artist", "album", "genre", "label", "bpm", "key", "duration_sec", "location", "rating", "date_added", "crate", "position"]


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df over the partitions it has rows for; others stay. Check df before: this is the only write."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replace_partition(df: DataFrame, path: str, **keys: str) -> None:
    """Makes df the content of the one partition that keys name, also if df has no rows.

    df is computed and kept beside the table first. The kept rows are then written as new files, and only the
    commit of that write takes the old ones away; a failure before it leaves the old partition in place. Without rows
    the partition is overwritten by an empty file, half of which is the same.
    """
    ready = staged(df, "ready")
    if not ready.isEmpty():
        replace_partitions(ready.withColumns({name: F.lit(value) for name, value in keys.items()}), path, *keys)
        return
    escape = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    place = "/".join(f"{name}={escape(value)}" for name, value in keys.items())
    ready.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{place}")


def write_snapshot(df: DataFrame, path: str, layout_version: int) -> None:
    replace_partitions(df.withColumn("layout_version", F.lit(layout_version)), path, "layout_version")


def read_snapshot(spark: SparkSession, path: str, layout_version: int) -> DataFrame:
    """The snapshot of a version; no rows where there is none."""
    return spark.read.parquet(path).where(C("layout_version") == layout_version).drop("layout_version")


def csv_rows(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows of a crate's CSV as text: nulls are empty, tracks that aren't known are left out."""
    met = items.join(tracks, "track_id")
    return met.select(*[F.coalesce(C(c).cast("string"), F.lit("")).alias(c) if c in met.columns else F.lit("").alias(c) for c in EXPORT])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.repartition(C("crate")).sortWithinPartitions("crate", C("position").cast("long")).write.option("header", True).option("emptyValue", "").csv(path)


def m3u_lines(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """(crate, line, text) of each crate's playlist file."""
    met = items.join(tracks, "track_id").withColumn("_n", F.row_number().over(Window.partitionBy("crate").orderBy("position", "track_id")))
    shown = F.coalesce(F.nullif(F.concat_ws(" - ", F.nullif("artist", F.lit("")), F.nullif("title", F.lit(""))), F.lit("")), C("track_id"))
    info = F.concat(F.lit("#EXTINF:"), F.coalesce(C("duration_sec").cast("long"), F.lit(-1)).cast("string"), F.lit(","), shown)
    place = F.coalesce(F.nullif("location", F.lit("")), C("track_id"))
    body = met.select("crate", F.posexplode(F.array(info, place)).alias("_i", "text"), "_n").select("crate", (2 * C("_n") + C("_i")).alias("line"), "text")
    head = items.select("crate").distinct().select("crate", F.posexplode(F.array(F.lit("#EXTM3U"), F.concat(F.lit("#PLAYLIST:"), "crate"))).alias("line", "text"))
    return head.union(body.select("crate", C("line").cast("int"), "text"))


def write_m3u(lines: DataFrame, path: str) -> None:
    """A folder for each crate; a crate's lines are in one file, in order."""
    lines.repartition(C("crate")).sortWithinPartitions("crate", "line").select("crate", "text").write.partitionBy("crate").text(path)


def _attribute(name: str, value) -> F.Column:
    safe = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.concat(F.lit(f' {name}="'), safe, F.lit('"'))


def location_uri(place) -> F.Column:
    quoted = F.regexp_replace(F.replace(F.replace(F.url_encode(place), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), "%7E", "~")
    return F.when(S.text(place) == "", "").when(place.startswith("file://"), place).when(quoted.startswith("/"), F.concat(F.lit("file://localhost"), quoted)).otherwise(F.concat(F.lit("file://localhost/"), quoted))


def collection_lines(export_id: str, tracks: DataFrame, items: DataFrame, assigned: DataFrame, product: str) -> DataFrame:
    """(section, major, minor, text): an export's XML, to be read in this order.

    Sections: 0 head, 1 tracks (each once, first seen in crates, then in assignments), 2 folders of crates,
    clusters (without outliers, by number) and moments, 9 end.
    """
    zero = F.lit(0).cast("long")
    seen = items.select("track_id", F.lit(0).alias("_s"), F.struct("crate", C("position").cast("long").alias("position")).alias("_o")).union(assigned.select("track_id", F.lit(1), F.struct(F.lit("").alias("crate"), C("position").cast("long").alias("position"))))
    first = seen.groupBy("track_id").agg(F.min(F.struct("_s", "_o")).alias("_f"))
    t = first.join(tracks, "track_id")
    optional = lambda name, c, value: F.coalesce(F.when(S.text(C(c).cast("string")) != "", _attribute(name, value)), F.lit(""))
    node = F.concat(F.lit("    <TRACK"), _attribute("TrackID", C("track_id")), _attribute("Name", C("title")), _attribute("Artist", C("artist")), _attribute("Location", location_uri(C("location"))), optional("AverageBpm", "bpm", F.format_string("%.2f", C("bpm"))), optional("Tonality", "key", C("key")), optional("Genre", "genre", C("genre")), F.lit("/>"))
    body = t.select(F.lit(1).alias("section"), F.concat(C("_f._s").cast("string"), C("_f._o")["crate"]).alias("major"), C("_f._o")["position"].alias("minor"), node.alias("text"))
    groups = items.select(F.lit("0").alias("folder"), C("crate").alias("name"), C("crate").alias("sort"), "track_id", C("position").cast("long").alias("position"))
    own = assigned.where("cluster <> -1")
    groups = groups.union(own.select(F.lit("1"), F.concat(C("cluster").cast("string"), F.lit(" · "), "cluster_name"), F.lpad(C("cluster").cast("string"), 9, "0"), "track_id", C("position").cast("long")))
    groups = groups.union(assigned.select(F.lit("2"), F.coalesce(F.nullif("moment", F.lit("")), F.lit("Unassigned")), F.coalesce("moment", F.lit("")), "track_id", C("position").cast("long")))
    key = F.concat_ws("/", "folder", "sort")
    leaf = groups.select(F.lit(2).alias("section"), key.alias("major"), (C("position") + 1).alias("minor"), F.concat(F.lit("        <TRACK"), _attribute("Key", C("track_id")), F.lit("/>")).alias("text"))
    heads = groups.groupBy("folder", "sort", "name").count()
    opened = heads.select(F.lit(2), key, F.lit(-1).cast("long"), F.concat(F.lit("      <NODE"), _attribute("Name", C("name")), F.lit(' Type="1" KeyType="0"'), _attribute("Entries", C("count")), F.lit(">")))
    closed = heads.select(F.lit(2), key, F.lit((1 << 62)), F.lit("      </NODE>"))
    folders = {"0": "crates", "1": "clusters", "2": "moments"}
    named = F.element_at(F.create_map(*[F.lit(x) for kv in folders.items() for x in kv]), C("folder"))
    counts = heads.groupBy("folder").count()
    folder_open = counts.select(F.lit(2), C("folder"), F.lit(-2).cast("long"), F.concat(F.lit("    <NODE Type=\"0\""), _attribute("Name", F.concat(F.lit(f"{product} — "), named)), _attribute("Count", C("count")), F.lit(">")))
    folder_close = counts.select(F.lit(2), F.concat("folder", F.lit("0")), zero, F.lit("    </NODE>"))
    n = first.agg(F.count("*").alias("n"))
    head = n.select(F.lit(0).alias("section"), F.lit("").alias("major"), zero.alias("minor"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0">\n  <PRODUCT'), _attribute("Name", F.lit(product)), F.lit(' Version="0.1.0"/>\n  <COLLECTION'), _attribute("Entries", C("n")), F.lit(">")).alias("text"))
    middle = n.select(F.lit(1), F.lit("9"), zero, F.lit('  </COLLECTION>\n  <PLAYLISTS>\n    <NODE Type="0" Name="ROOT" Count="0">'))
    end = n.select(F.lit(9), F.lit(""), zero, F.lit("    </NODE>\n  </PLAYLISTS>\n</DJ_PLAYLISTS>"))
    out = head
    for part in (body, middle, folder_open, opened, leaf, closed, folder_close, end):
        out = out.union(part)
    return out.withColumn("export_id", F.lit(export_id))
