"""Merges: upserts, precedence of sources, reuse of cached evidence, replay of edits.

Inputs are whole tables or the partitions of a run; results replace them by a dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import scalars as S
from tracklens.sources.shared import staged

C = F.col
#: Sources of metadata, the strongest first.
PRECEDENCE = ["user", "usb", "csv", "tag", "estimate"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row for each key, the latest by sequence."""
    rows = old.unionByName(new)
    latest = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def cache_todo(work: DataFrame, cache: DataFrame, mode: str = "reuse") -> DataFrame:
    """Work that the cache doesn't answer. reuse: any ended state answers; retry: only success; overwrite: nothing."""
    if mode == "overwrite":
        return work
    ended = ["succeeded", "skipped"] if mode == "retry" else ["succeeded", "skipped", "failed"]
    return work.join(cache.where(C("status").isin(ended)).select("cache_key").distinct(), "cache_key", "left_anti")


def _blank(c: str, kind: str) -> Column:
    return F.nullif(c, F.lit("")) if kind == "string" else C(c)


def upsert_metadata(old: DataFrame, new: DataFrame, always: list[str], key: str = "track_id") -> DataFrame:
    """Incoming values win if they aren't missing; those in ``always`` win in any case."""
    kinds = dict(old.dtypes)
    o, n = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("_o")), new.select(key, F.struct(*[c for c in old.columns if c != key]).alias("_n"))
    met = o.join(n, key, "full")

    def merged(c: str) -> Column:
        keep = F.coalesce(_blank_of(C(f"_n.{c}"), kinds[c]), C(f"_o.{c}"))
        return (F.when(C("_n").isNotNull(), C(f"_n.{c}")).otherwise(C(f"_o.{c}")) if c in always else keep).alias(c)

    return met.select(key, *[merged(c) for c in old.columns if c != key])


def _blank_of(c: Column, kind: str) -> Column:
    return F.nullif(c, F.lit("")) if kind == "string" else c


def fill_missing(old: DataFrame, new: DataFrame, source: str, stamped: list[str], key: str = "track_id") -> DataFrame:
    """Existing values win; a column in ``stamped`` that was filled tells its source."""
    kinds = dict(old.dtypes)
    values = [c for c in old.columns if c != key]
    met = old.join(new.select(key, *[C(c).alias(f"_{c}") for c in values]), key, "left")
    have = {c: _blank(c, kinds[c]) for c in values}
    sources = [F.when(have[c].isNull() & C(f"_{c}").isNotNull(), source).alias(f"{c}_source") for c in stamped]
    return met.select(key, *[F.coalesce(have[c], C(f"_{c}"), C(c)).alias(c) for c in values], *sources)


def retain_sources(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each match; the first import's time stays."""
    return old.unionByName(new).groupBy(*keys).agg(F.min("imported_at").alias("imported_at"), F.max("updated_at").alias("updated_at"))


def bpm_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > 0.05, F.lit(False))


def key_conflict(a: Column, b: Column) -> Column:
    x, y = S.canonical_key(a), S.canonical_key(b)
    return (x != "") & (y != "") & (x != y)


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(wanted.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def tag_rows(rows: DataFrame) -> DataFrame:
    """Rows that have an object, with names filled in."""
    named = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).alias(c)
    return rows.where(S.text(C("object_key")) != "").select(*[named(c, {"title": "Untitled", "artist": "Unknown artist"}[c]) if c in ("title", "artist") else C(c) for c in rows.columns])


def by_precedence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the value of the strongest source that has one."""
    strength = F.array_position(F.array(*map(F.lit, PRECEDENCE)), C("source"))
    return rows.where(S.text(C("value")) != "").groupBy(*keys).agg(F.min_by("value", strength).alias("value"))


def feature_map(tall: DataFrame) -> DataFrame:
    """A map of features for each track."""
    return tall.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_key", "value"))).alias("features"))


def replay_crate(edits: DataFrame) -> DataFrame:
    """(crate_id, track_id, position): what crates hold after their edits, in the order in which tracks came in.

    edits: (crate_id, track_id, seq, action). ``add`` and ``remove`` do nothing if the track is in, or out,
    already, so an added track keeps its place; ``toggle`` does the one that does something; ``remove_all``,
    without a crate, removes the track from every crate, after what crates do at the same seq.
    """
    own = edits.where("action <> 'remove_all'").select("crate_id", "track_id", "seq", "action")
    # whatever a crate did with a track before the track's last removal from all crates is undone by it
    cleared = staged(edits.where("action = 'remove_all'").groupBy("track_id").agg(F.max("seq").alias("_cleared")), "cleared")
    every = own.join(cleared, "track_id", "left").where(C("_cleared").isNull() | (C("seq") > C("_cleared"))).drop("_cleared")
    order = Window.partitionBy("crate_id", "track_id").orderBy("seq")
    toggles = F.sum(F.when(C("action") == "toggle", 1).otherwise(0)).over(order)
    set_ = F.last(F.when(C("action") != "toggle", F.struct((C("action") == "add").alias("was"), C("_t").alias("t"))), True).over(order)
    state = every.withColumn("_t", toggles).withColumn("_s", set_)
    is_in = F.coalesce(C("_s.was"), F.lit(False)) != ((C("_t") - F.coalesce(C("_s.t"), F.lit(0))) % 2 == 1)
    state = state.withColumn("_in", is_in).withColumn("_came", C("_in") & ~F.lag("_in", 1, False).over(order))
    now = state.groupBy("crate_id", "track_id").agg(F.max_by("_in", "seq").alias("_in"), F.max(F.when(C("_came"), C("seq"))).alias("seq")).where("_in")
    return now.select("crate_id", "track_id", (F.row_number().over(Window.partitionBy("crate_id").orderBy("seq", "track_id")) - 1).alias("position"))
