"""Kept neighbours equal those of a full run after any change, at the price of the changed ones."""

import numpy as np
import pytest

from tracklens.operators import neighbour_store, similarity
from tracklens.operators.neighbour_store import NeighbourStore

SCHEMA = "track_id string, embedding array<double>"


def full(x: dict, mean, sd, k):
    """{source: [targets]} by numpy with given statistics."""
    ids = sorted(x)
    z = (np.array([x[i] for i in ids]) - mean) / sd
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    score = u @ u.T
    np.fill_diagonal(score, -np.inf)
    return {i: [ids[j] for j in np.argsort(-s, kind="stable")[: min(k, len(ids) - 1)]] for i, s in zip(ids, score)}


def stored(store):
    out: dict = {}
    for r in sorted(store.lists().collect(), key=lambda r: (r.source, r.rank)):
        out.setdefault(r.source, []).append(r.target)
        assert r.rank == len(out[r.source])
    return out


@pytest.mark.parametrize("block", [2000, 50])
def test_updates_equal_a_full_run(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = {f"t{i:04}": v for i, v in enumerate(rng.normal(size=(240, 8)).tolist())}
    frame = lambda: spark.createDataFrame(list(x.items()), SCHEMA).repartition(3)
    a = np.array(list(x.values()))
    mean, sd = a.mean(0), a.std(0)
    store = NeighbourStore.build(frame(), str(tmp_path / "n"), 5)
    assert stored(store) == full(x, mean, sd, 5)

    for i in range(9):
        x[f"n{i}"] = rng.normal(size=8).tolist()  # added
    report = store.update(frame())
    assert report == {"added": 9, "changed": 0, "removed": 0, "recomputed": 0, "pairs": 9 * 249} and stored(store) == full(x, mean, sd, 5)

    for i in range(3):
        x[f"t{i:04}"] = rng.normal(size=8).tolist()  # changed
        del x[f"t{100 + i:04}"]  # removed
    before = store.lists()
    report = store.update(frame())
    assert (report["added"], report["changed"], report["removed"]) == (0, 3, 3)
    assert report["pairs"] == (3 + report["recomputed"]) * 246 < 246 * 246 / 2
    assert stored(store) == full(x, mean, sd, 5)
    assert before.count() == 249 * 5  # the old version is still there

    assert store.update(frame())["pairs"] == 0 and store.version() == 2  # nothing to do
    assert [r.target for r in store.nearest("n0", 2).collect()] == full(x, mean, sd, 5)["n0"][:2]
    ranked = store.rank("n0", 30).collect()  # more than a list holds
    assert [r.track_id for r in ranked] == full(x, mean, sd, 30)["n0"] and store.rank("none").count() == 0


def test_few_tracks_and_failures(spark, tmp_path, monkeypatch):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])]
    store = NeighbourStore.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "n"), 5)
    assert {s: len(t) for s, t in stored(store).items()} == {"a": 2, "b": 2, "c": 2}
    first = stored(store)
    with pytest.raises(ValueError):
        store.update(spark.createDataFrame([*rows, rows[0]], SCHEMA))
    monkeypatch.setattr(neighbour_store, "top_k", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.update(spark.createDataFrame(rows[:2], SCHEMA))
    assert stored(store) == first and store.version() == 0
    monkeypatch.undo()
    store.update(spark.createDataFrame(rows[:1], SCHEMA))
    assert stored(store) == {}
