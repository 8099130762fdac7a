"""A map of a corpus that keeps neighbours near each other.

1. Graph: each track's k nearest tracks by cosine (``knn``). A track's nearest has strength 1, others
   exp(-(distance - nearest) / width), the width found by bisection so that the strengths add up to log2 k. The two
   strengths p and q of a pair become p + q - p q, so the graph has no direction.
2. Start: the map of the two leading principal components, its greatest coordinate put at SPAN.
3. Rounds: tracks are dealt to parts of about PART tracks that lie side by side on the map. A task moves the tracks of
   its part for some steps, while the others stay where the round began: edges, drawn in each step with a chance
   of their strength, pull, and for each of them REPEL tracks of a sample push. The step length falls to 0 over all rounds.

A task holds a part's tracks and edges, and a sample of the map of about SAMPLE places. Everything random comes
from the seed, the round and the part, on rows in the order of ids, and places at the start have six places, strengths nine;
so a map can be made again.

Defined results: tracks without a direction (see ``knn``) or neighbours stay where they start; one track lies at the
origin; an empty corpus gives an empty map.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.operators import projection, similarity
from tracklens.operators.aggregates import standardize
from tracklens.sources.shared import staged

C = F.col
# The curve 1 / (1 + A d**(2 B)) that stands for a least distance of 0.1 and a spread of 1.
A, B = 1.577, 0.895
#: Greatest coordinate at the start, tracks of a part, places that push, pushes for each pull, greatest force.
SPAN, PART, SAMPLE, REPEL, LIMIT = 10.0, 4096, 4096, 5, 4.0


def strengths(k: int):
    """Column function: sorted distances of a track's neighbours to their strengths."""

    @F.pandas_udf("array<double>")
    def of(distances: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for row in distances:
            over = np.asarray(row, float) - row[0]
            low, high, width = 0.0, math.inf, 1.0
            for _ in range(64):
                if np.exp(-over / width).sum() > math.log2(k):
                    high = width
                else:
                    low = width
                width = 2 * width if math.isinf(high) else (low + high) / 2
            out.append(np.exp(-over / max(width, 1e-12)))
        return pd.Series(out)

    return of


def neighbour_graph(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(source, target, w) with both directions of each edge, staged; vectors: (track_id, model, embedding)."""
    near = similarity.knn(vectors, k, strict=False)
    lists = near.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("distance", "target"))).alias("n"))  # k of each
    directed = lists.select("source", F.explode(F.arrays_zip(C("n.target").alias("target"), strengths(max(2, k))(C("n.distance")).alias("p"))).alias("e")).select("source", "e.target", "e.p")
    both = directed.union(directed.select("target", "source", "p")).groupBy("source", "target").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"))
    return staged(both.select("source", "target", F.when(C("n") == 2, C("low") + C("high") - C("low") * C("high")).otherwise(C("high")).alias("w")).withColumn("w", F.round("w", 9)), "graph")


def _step(places, source, target, fixed, w, pushers, rate, rng):
    """One step of the part's places, in place. target is -1 where the other end is fixed."""
    import numpy as np

    n = len(places)
    drawn = np.flatnonzero(rng.random(len(source)) < w)
    own, other = source[drawn], target[drawn]
    away = places[own] - np.where(other[:, None] >= 0, places[other], fixed[drawn])
    d = (away**2).sum(1)
    pull = np.where(d > 0, -2 * A * B * np.maximum(d, 1e-12) ** (B - 1) / (1 + A * d**B), 0.0)
    pulled = np.clip(pull[:, None] * away, -LIMIT, LIMIT)
    again = np.repeat(own, REPEL)
    away = places[again] - pushers[rng.integers(0, len(pushers), len(again))]
    d = (away**2).sum(1)
    push = np.where(d > 0, 2 * B / ((0.001 + d) * (1 + A * d**B)), 0.0)
    pushed = np.clip(push[:, None] * away, -LIMIT, LIMIT)
    for axis in range(places.shape[1]):
        places[:, axis] += rate * (np.bincount(own, pulled[:, axis], n) + np.bincount(again, pushed[:, axis], n))


def _mover(sample: list, alone: bool, first: int, steps: int, total: int, rate: float, seed: int):
    """Moves one part: tracks (track_id, p), edges (source, target, w, other)."""

    def move(key, tracks, edges):
        import numpy as np

        if not len(tracks):
            return tracks[["track_id", "p"]]
        tracks = tracks.sort_values("track_id", ignore_index=True)
        edges = edges.sort_values(["source", "target"], ignore_index=True)
        places = np.stack(tracks["p"]).astype(float)
        index = pd.Index(tracks["track_id"])
        source, target = index.get_indexer(edges["source"]), index.get_indexer(edges["target"])
        fixed = np.stack(edges["other"]) if len(edges) else np.zeros((0, places.shape[1]))
        w = edges["w"].to_numpy(float)
        rng = np.random.default_rng([seed, first, int(key[0])])
        for step in range(first, first + steps):
            _step(places, source, target, fixed, w, places.copy() if alone else np.array(sample), rate * (1 - step / total), rng)
        return pd.DataFrame({"track_id": tracks["track_id"], "p": list(places)})

    return move


def _dealt(places: DataFrame, parts: int, axis: int) -> DataFrame:
    """places with their part: slices of the map along an axis."""
    if parts == 1:
        return places.withColumn("part", F.lit(0))
    cuts = places.agg(F.percentile_approx(C("p")[axis], [i / parts for i in range(1, parts)], 100 * parts)).first()[0]  # a number a part
    return places.withColumn("part", F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c < C("p")[axis])))


def lay_out_graph(start: DataFrame, edges: DataFrame, rounds: int | None = None, steps: int = 40, rate: float = 0.15, seed: int = 42) -> DataFrame:
    """(track_id, x, y) of staged start (track_id, p) and edges. A single part needs no rounds, only their steps."""
    n = start.count()
    parts = max(1, math.ceil(n / PART))
    rounds = rounds or 6
    if parts == 1:
        rounds, steps = 1, rounds * steps
    total = rounds * steps
    places, kinds = start, {c: k for c, k in start.dtypes}
    for r in range(rounds):
        now = _dealt(places, parts, r % 2)
        chance = F.pmod(F.xxhash64("track_id", F.lit(seed + r)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 20))
        sample = [] if parts == 1 else [x.p for x in places.where(chance).orderBy("track_id").select("p").collect()]  # about SAMPLE rows
        met = edges.join(now.select(C("track_id").alias("source"), C("part").alias("own")), "source").join(places.select(C("track_id").alias("target"), C("p").alias("other")), "target")
        move = _mover(sample or [[0.0, 0.0]], parts == 1, r * steps, steps, total, rate, seed)
        moved = now.groupBy("part").cogroup(met.groupBy("own")).applyInPandas(move, f"track_id {kinds['track_id']}, p array<double>")
        places = staged(moved, "places")
    return places.select("track_id", C("p")[0].alias("x"), C("p")[1].alias("y"))


def neighbour_map(vectors: DataFrame, k: int = 15, **settings) -> DataFrame:
    """(track_id, x, y) of vectors (track_id, model, embedding)."""
    edges = neighbour_graph(vectors, k)
    mean, axes = projection.principal_axes(standardize(vectors.select("track_id", "embedding"), 1e-8))
    first = staged(projection.project(standardize(vectors.select("track_id", "embedding"), 1e-8), mean, axes).select("track_id", "x", "y"), "start")
    far = first.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    start = staged(first.select("track_id", F.array(*[F.round(C(c) * (SPAN / far), 6) for c in ("x", "y")]).alias("p")), "start")
    return lay_out_graph(start, edges, **settings)


def kept_neighbours(points: DataFrame, near: DataFrame, k: int = 10) -> float:
    """Mean share of a track's k nearest (source, target, rank) that are among its k nearest on the map (track_id, x, y).

    The map's nearest are found by ``knn`` of places lifted to a sphere so wide that its cosines fall as distances grow.
    """
    far = points.agg(F.max(F.hypot("x", "y"))).first()[0] or 1.0
    lifted = points.select("track_id", F.lit("map").alias("model"), F.array("x", "y", F.sqrt(F.pow(F.lit(100 * far), 2) - C("x") * C("x") - C("y") * C("y"))).alias("embedding"))
    own = similarity.knn(lifted, k, zscore=False).select("source", "target", F.lit(1).alias("hit"))
    return near.where(C("rank") <= k).join(own, ["source", "target"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
