"""Evidence: windows of audio, runs of extractors, and Python extractors on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col

PLAN = "version string, strategy string, window_sec double, hop_sec double, count int, edge_skip double, minimum_core_sec double, max_core_sec double, legacy boolean"
# The window plans that exist.
PLANS = [
    ("legacy-librosa-v1", "central", None, None, None, 0.15, 20.0, 120.0, True),
    ("legacy-essentia-v1", "central", None, None, None, 0.15, 20.0, 90.0, True),
    ("legacy-clap-v1", "even", 10.0, None, 3, 0.15, 20.0, 120.0, True),
    ("sampled-v1", "even", 10.0, None, 3, 0.0, 20.0, None, False),
    ("full-overlap-v1", "overlap", 10.0, 5.0, None, 0.0, 20.0, None, False),
]


def expand_windows(audio: DataFrame, plans: DataFrame) -> DataFrame:
    """(track_id, version, index, start, end, start_ms, end_ms) of audio (track_id, frames, rate) under each plan."""
    frames = lambda seconds: F.floor(seconds * C("rate"))
    skip = F.floor(C("frames") * C("edge_skip"))
    d = audio.where("frames > 0").crossJoin(F.broadcast(plans))
    d = d.withColumn("_long", C("frames") - 2 * skip >= frames(C("minimum_core_sec")))
    d = d.withColumn("_a", F.when(C("_long"), skip).otherwise(F.lit(0))).withColumn("_b", C("frames") - C("_a"))
    over = C("_b") - C("_a") - frames(C("max_core_sec"))
    shift = F.when(over > 0, F.floor(over / 2)).otherwise(F.lit(0))
    d = d.withColumn("_a2", C("_a") + shift).withColumn("_b2", F.when(over > 0, C("_a2") + frames(C("max_core_sec"))).otherwise(C("_b")))
    core, size, hop = C("_b2") - C("_a2"), frames(C("window_sec")), frames(C("hop_sec"))
    n = F.when(C("legacy"), F.least(C("count"), F.greatest(F.lit(1), F.floor(core / size)))).otherwise(C("count")).cast("int")
    span = core - size
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: C("_a2") + F.when(n == 1, 0).otherwise(F.floor(i * span / F.greatest(n - 1, F.lit(1))))))
    last = C("_b2") - size
    stepped = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(span / hop).cast("int")), lambda i: C("_a2") + i * hop), F.array(last)))
    whole = (C("strategy") == "central") | (core <= size)
    starts = F.when(whole, F.array(C("_a2"))).when(C("strategy") == "even", even).otherwise(stepped)
    d = d.select("track_id", "version", "rate", F.posexplode(F.transform(starts, lambda x: x.cast("long"))).alias("index", "start"), F.when(whole, core).otherwise(size).cast("long").alias("_n"))
    d = d.withColumn("end", C("start") + C("_n"))
    ms = lambda c: F.floor(C(c) * 1000 / C("rate")).cast("long")
    return d.select("track_id", "version", "index", "start", "end", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def plan_errors(plans: DataFrame) -> DataFrame:
    """(version, error) of plans that contradict themselves."""
    given = lambda c: C(c).isNotNull()
    low = F.lit(False)
    for c in ("window_sec", "hop_sec", "count", "minimum_core_sec", "max_core_sec"):
        low = low | F.coalesce(C(c) <= 0, F.lit(False))
    error = (
        F.when(F.coalesce(F.trim("version"), F.lit("")) == "", "no version")
        .when(low, "must be positive")
        .when(~C("edge_skip").between(0, 0.4999999999), "edge_skip out of range")
        .when((C("strategy") == "central") & (given("window_sec") | given("hop_sec") | given("count")), "central takes no window, hop or count")
        .when((C("strategy") == "even") & (~given("window_sec") | ~given("count") | given("hop_sec")), "even takes window and count")
        .when((C("strategy") == "overlap") & (~given("window_sec") | ~given("hop_sec") | given("count")), "overlap takes window and hop")
        .when(~C("strategy").isin("central", "even", "overlap"), "unknown strategy")
    )
    return plans.select("version", error.alias("error")).where("error IS NOT NULL")


def expand_run(run_id: str, tracks: DataFrame, manifest: DataFrame) -> DataFrame:
    """A stage for each track and extractor of a manifest (name, extractor_version, required, plan): each extractor once, required first."""
    from pyspark.sql import Window

    from tracklens.functions.scalars import cache_key

    order = Window.partitionBy("name", "extractor_version").orderBy(F.desc("required"), "position")
    once = manifest.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    pairs = tracks.select("track_id", "content_hash").crossJoin(F.broadcast(once))
    key = cache_key(C("content_hash"), C("name"), C("extractor_version"), C("plan"))
    return pairs.select(F.sha2(F.concat_ws("|", F.lit(run_id), C("track_id").cast("string"), "name", "extractor_version"), 256).alias("stage_id"), F.lit(run_id).alias("run_id"), "track_id", "name", "extractor_version", "required", key.alias("cache_key"))


class ExtractorRegistry:
    """Python extractors by name and version: f(row as a dict) -> {feature: number}."""

    def __init__(self):
        self._known: dict[tuple[str, str], Callable[[dict], dict]] = {}

    def register(self, name: str, version: str, f: Callable[[dict], dict]) -> None:
        if (name, version) in self._known:
            raise ValueError(f"{name} {version} is registered already")
        self._known[name, version] = f

    def resolve(self, name: str, version: str | None = None) -> tuple[str, Callable[[dict], dict]]:
        found = [(v, f) for (n, v), f in self._known.items() if n == name and version in (None, v)]
        if len(found) != 1:
            raise LookupError(f"{name} {version or ''}: {'several versions' if found else 'not registered'}")
        return found[0]

    def plan(self, wanted: list[tuple[str, str | None, bool]]) -> tuple[list[tuple[str, str, Callable]], list[str]]:
        """(extractors to run, optional ones that are missing); a missing required one is an error."""
        run, skipped = [], []
        for name, version, required in wanted:
            try:
                run.append((name, *self.resolve(name, version)))
            except LookupError:
                if required:
                    raise
                skipped.append(name)
        return run, skipped


def extract(rows: DataFrame, extractors: list[tuple[str, str, Callable[[dict], dict]]], key: str, attempts: int = 2) -> DataFrame:
    """(key, extractor, version, status, error, attempts, features): a failing row never stops the others."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for name, version, f in extractors:
                    error, features = "", {}
                    for attempt in range(1, attempts + 1):
                        try:
                            features = {k: float(v) for k, v in f(row).items()}
                            error = ""
                            break
                        except Exception as e:  # the row's own failure, kept as its result
                            error = f"{type(e).__name__}: {e}"
                    out.append((row[key], name, version, "failed" if error else "ok", error, attempt, features))
            yield pd.DataFrame(out, columns=[key, "extractor", "version", "status", "error", "attempts", "features"])

    kind = dict(rows.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind}, extractor string, version string, status string, error string, attempts int, features map<string,double>")


def signal_features(row: dict) -> dict:
    """Physical descriptors of one window's samples: level, zero crossings, crest, energy by band."""
    import numpy as np

    x, rate = np.asarray(row["samples"], float), float(row["rate"])
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("samples must be finite")
    rms = float(np.sqrt(np.mean(x * x)))
    power, freq = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    total = power.sum()
    share = lambda m: float(power[m].sum() / total) if total > 0 else 0.0
    crossings = np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])) if len(x) > 1 else 0.0
    values = {"rms": rms, "zero_crossing_rate": float(crossings), "crest": float(np.abs(x).max() / rms) if rms > 0 else 0.0, "low": share((freq >= 20) & (freq < 250)), "mid": share((freq >= 250) & (freq < 4000)), "high": share(freq >= 4000), "duration_sec": len(x) / rate}
    return {k: round(v, 6) for k, v in values.items()}
