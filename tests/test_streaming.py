import json

from pyspark.sql import functions as F

from tracklens.streaming import incremental


def test_stream_upserts_are_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [[("r1", "a", 1, 1.0), ("r2", "b", 1, 2.0)], [("r1", "a", 2, 5.0), ("r1", "c", 2, 6.0)], [("r1", "a", 1, 9.0)]]
    for n, rows in enumerate(files):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("run", "k", "seq", "value"), r))) for r in rows))
    stream = spark.readStream.schema("run string, k string, seq int, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    path = str(tmp_path / "table")
    incremental.upsert_stream(stream, path, str(tmp_path / "cp"), "run", ["run", "k"], "seq").awaitTermination()
    want = [("r1", "a", 2, 5.0), ("r1", "c", 2, 6.0), ("r2", "b", 1, 2.0)]
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("run", "k", "seq", "value").collect())
    assert read() == want
    again = spark.createDataFrame(files[1], "run string, k string, seq int, value double")
    incremental.upsert_batch(path, "run", ["run", "k"], "seq")(again, 1)
    assert read() == want


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.select("ts", "event_type").schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("count")).first()[0] == events.count()


def test_progress_of_runs_equals_the_batch_query(spark, tmp_path):
    """Replayed files, repeated and late events, leases that end; against the latest events of all."""
    import datetime
    import random

    import pytest

    from tracklens.operators.aggregates import stage_progress
    from tracklens.streaming import run_state

    pytest.importorskip("google.protobuf")
    start, rng = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC), random.Random(3)
    events = []
    for run in range(4):
        for stage in range(6):
            at, attempts = start + datetime.timedelta(minutes=rng.randint(0, 20)), 0
            for seq in range(rng.randint(1, 6)):
                status = rng.choice(["queued", "running", "failed", "succeeded", "skipped"])
                attempts += status == "running"
                lease = at + datetime.timedelta(minutes=rng.choice([5, 600])) if status == "running" else None
                events.append((f"r{run}", f"s{stage}", seq, status, rng.random() < 0.7, attempts + rng.choice([0, 2]), lease, at))
                at += datetime.timedelta(minutes=rng.randint(1, 5))
    events += rng.sample(events, 20)  # repeated
    rng.shuffle(events)  # late
    events += [("r9", "s0", 0, "succeeded", False, 1, None, start + datetime.timedelta(hours=h)) for h in (4, 5)]  # time goes on
    events += [(None, "s", 1, "queued", False, 0, None, start), ("r0", "s0", None, "running", False, 0, None, start)]
    names = [c.split()[0] for c in run_state.EVENT.split(", ")]
    (tmp_path / "in").mkdir()
    for n in range(0, len(events), 25):
        rows = [{k: v.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(v, datetime.datetime) else v for k, v in zip(names, e)} for e in events[n : n + 25]]
        (tmp_path / "in" / f"{n:04}.json").write_text("\n".join(map(json.dumps, rows)))
    name, provider = run_state.STATE_STORE
    spark.conf.set(name, provider)
    try:
        stream = spark.readStream.schema(run_state.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = run_state.run_progress(stream, "3 hours").writeStream.outputMode("update").format("memory").queryName("progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(name)
    got = {r.run_id: r for r in spark.sql("SELECT * FROM progress").orderBy("version").collect()}

    latest: dict = {}
    for e in events:
        if None not in (e[0], e[2]) and (e[:2] not in latest or latest[e[:2]][2] < e[2]):
            latest[e[:2]] = e
    now, rows = start + datetime.timedelta(hours=2), []  # the last event less three hours
    for run, stage, _, status, retryable, attempts, lease, _ in latest.values():
        if status == "running" and lease <= now:
            status, retryable = ("failed", False) if attempts >= 3 else ("queued", retryable)
        rows.append((run, stage, status, retryable, attempts))
    stages = spark.createDataFrame(rows, "run_id string, stage_id string, status string, retryable boolean, attempt_count int")
    want = {r.run_id: (r.total, r.done, r.running, r.failed) for r in stage_progress(stages, ["run_id"]).collect()}
    assert {i: (r.total, r.done, r.running, r.failed) for i, r in got.items()} == want
    assert {i: r.eligible for i, r in got.items()} == {i: sum(s == "queued" or (s == "failed" and y and a < 3) for r, _, s, y, a in rows if r == i) for i in want}
