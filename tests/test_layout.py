"""The neighbour map keeps more neighbours than principal components do."""

import math

import numpy as np
import pytest

from tracklens.operators import layout, projection, similarity


def corpus(spark, n=400, groups=6):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 6, (groups, 12))[np.arange(n) % groups] + rng.normal(0, 1, (n, 12))
    return x, spark.createDataFrame([(f"t{i:04}", "m", v.tolist()) for i, v in enumerate(x)], "track_id string, model string, embedding array<double>")


@pytest.mark.parametrize("part", [4096, 120])
def test_map_keeps_more_neighbours_than_two_components(spark, part, monkeypatch):
    monkeypatch.setattr(layout, "PART", part)
    monkeypatch.setattr(layout, "SAMPLE", 200)
    _, vectors = corpus(spark)
    near = similarity.knn(vectors, 10).cache()
    plain = layout.kept_neighbours(projection.standard_map(vectors.select("track_id", "embedding")), near)
    points = layout.neighbour_map(vectors)
    rows = sorted(map(tuple, points.collect()))
    kept = layout.kept_neighbours(points, near)
    assert len(rows) == 400 and all(math.isfinite(v) for r in rows for v in r[1:])
    assert kept > 1.4 * plain
    if part == 4096:
        assert rows == sorted(map(tuple, layout.neighbour_map(vectors.repartition(3)).collect()))  # a fixed seed


def test_strengths_add_up_and_pairs_have_one_strength(spark):
    x, vectors = corpus(spark, 60)
    k = 8
    rows = layout.neighbour_graph(vectors, k).collect()
    got = {(r.source, r.target): r.w for r in rows}
    assert all(math.isclose(got[b, a], w) and 0 < w <= 1 for (a, b), w in got.items())
    z = (x - x.mean(0)) / x.std(0)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    d = 1 - u @ u.T + 9 * np.eye(60)
    own = {}
    for i in range(60):
        at = np.argsort(d[i])[:k]
        low, high = 1e-9, 1e3
        for _ in range(200):
            width = math.sqrt(low * high)
            low, high = (low, width) if np.exp(-(d[i, at] - d[i, at[0]]) / width).sum() > math.log2(k) else (width, high)
        own |= {(i, int(j)): math.exp(-(d[i, j] - d[i, at[0]]) / low) for j in at}
    want = {(i, j): own.get((i, j), 0) + own.get((j, i), 0) - own.get((i, j), 0) * own.get((j, i), 0) for i, j in {*own, *((j, i) for i, j in own)}}
    assert {(int(a[1:]), int(b[1:])) for a, b in got} == set(want)
    assert all(math.isclose(got[f"t{i:04}", f"t{j:04}"], w, rel_tol=1e-5, abs_tol=1e-7) for (i, j), w in want.items())


def test_few_tracks(spark):
    schema = "track_id string, model string, embedding array<double>"
    for rows in ([], [("a", "m", [1.0, 2.0])], [("a", "m", [1.0, 2.0]), ("b", "m", [2.0, 1.0])]):
        got = layout.neighbour_map(spark.createDataFrame(rows, schema)).collect() if rows else []
        assert len(got) == len(rows) and all(math.isfinite(v) for r in got for v in (r.x, r.y))
