"""The driver's tables as the catalogue's: each DataFrame here has its twin in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (column, expression) that Spark SQL and DuckDB read alike.
TRACKS = [
    ("track_id", "concat('t', lpad(CAST(vec_id AS STRING), 6, '0'))"),
    ("library_id", "CASE WHEN vec_id % 5 = 0 THEN 'L2' ELSE 'L1' END"),
    ("title", "concat('Track ', CAST(vec_id % 450 AS STRING))"),
    ("artist", "CASE WHEN vec_id % 41 = 0 THEN '' ELSE concat('Artist ', CAST((vec_id % 450) % 40 AS STRING)) END"),
    ("genre", "CASE label WHEN 0 THEN 'Deep House' WHEN 1 THEN 'Techno' WHEN 2 THEN 'Nu-Disco' WHEN 3 THEN 'Nu Disco' WHEN 4 THEN 'Ambient' WHEN 5 THEN 'Tech House' WHEN 6 THEN 'Progressive House' WHEN 7 THEN 'UK Garage' WHEN 8 THEN 'Minimal' ELSE '' END"),
    ("label", "CASE WHEN vec_id % 3 = 0 THEN 'Basalt' ELSE 'Harbour Editions' END"),
    ("bpm", "CASE WHEN vec_id % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(108 + (vec_id * 7) % 29 AS DOUBLE) END"),
    ("musical_key", "CASE WHEN vec_id % 19 = 0 THEN '' ELSE concat(CAST(1 + vec_id % 12 AS STRING), CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END) END"),
    ("energy_rating", "CASE WHEN vec_id % 11 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + vec_id % 10 AS INT) END"),
    ("duration_sec", "CAST(180 + (vec_id * 13) % 240 AS DOUBLE)"),
    ("location", "concat('/Contents/Artist ', CAST(vec_id % 40 AS STRING), '/Album/', CAST(vec_id AS STRING), '.wav')"),
    ("cluster", "CAST(label AS INT)"),
    ("x", "CAST(embedding[{0}] AS DOUBLE)"),
    ("y", "CAST(embedding[{1}] AS DOUBLE)"),
    ("embedding", "embedding"),
    ("created_at", "vec_id * 37 % 1000"),
]
JUDGMENTS = [
    ("judgment_id", "event_id"),
    ("evaluator_id", "concat('u', CAST(user_id AS STRING))"),
    ("anchor_track_id", "concat('t', lpad(CAST(event_id % 8 AS STRING), 6, '0'))"),
    ("configuration_id", "CASE WHEN event_id % 2 = 0 THEN 'c1' ELSE 'c2' END"),
    ("dimension", "CASE WHEN event_type = 'view' THEN 'drums' ELSE 'overall' END"),
    ("judgment", "CASE WHEN event_type = 'error' THEN 'skip' WHEN event_type IN ('purchase','signup') THEN 'similar' ELSE 'not_similar' END"),
    ("rank_position", "CAST(1 + event_id % 10 AS INT)"),
    ("ordinal_rating", "CAST(event_id % 5 AS INT)"),
]
#: A run of analysis per order, a stage per line.
STAGES = [
    ("run_id", "l_orderkey"),
    ("stage_id", "l_orderkey * 10 + l_linenumber"),
    ("track_id", "l_partkey % 200"),
    ("extractor", "CASE WHEN l_suppkey % 3 = 0 THEN 'librosa' WHEN l_suppkey % 3 = 1 THEN 'clap' ELSE 'essentia' END"),
    ("status", "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'running' WHEN l_linenumber = 2 THEN 'skipped' ELSE 'queued' END"),
    ("attempt_count", "CAST(1 + l_orderkey % 3 AS INT)"),
    ("retryable", "l_linenumber % 2 = 0"),
    ("cache_key", "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('k', CAST(l_partkey AS STRING)) END"),
    ("created_at", "l_shipdate"),
    ("finished_at", "l_shipdate"),
]
SOURCES = {"tracks": ("embeddings", TRACKS), "judgments": ("events", JUDGMENTS), "stages": ("lineitem", STAGES)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the catalogue, or one of the driver's by its own name."""
    if name not in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns = SOURCES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e.format(0, 1)} AS {c}" for c, e in columns])


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query over the named tables of the catalogue."""
    parts = [f"{n} AS (SELECT " + ", ".join(f"{e.format(1, 2)} AS {c}" for c, e in SOURCES[n][1]) + f" FROM {SOURCES[n][0]})" for n in names]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
