import random
import zlib

import numpy as np
import pytest

from tracklens.llm import quality_net as Q


def plain_score(net, raw):
    """A text's score with loops: every chunk, every place, every filter."""
    h = []
    for n in range(Q.chunk_count(len(raw))):
        chunk = [raw[i] if i < len(raw) else Q.PAD for i in range(n * Q.HOP, n * Q.HOP + Q.CHUNK)]
        tops = np.full(Q.FILTERS, -np.inf)
        for at in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE):
            seen = np.concatenate([net.vectors[b] for b in chunk[at : at + Q.WIDTH]])
            tops = np.maximum(tops, seen @ net.filters)
        h.append(np.maximum(np.maximum(tops + net.bias, 0) @ net.dense + net.dense_bias, 0))
    logit = np.mean(h, 0) @ net.mean_weight + np.max(h, 0) @ net.max_weight + net.last[0]
    return 1 / (1 + np.exp(-logit))


def test_scores_match_loops_whatever_the_slab(monkeypatch):
    rng = np.random.default_rng(1)
    net = Q.ByteNet(3)
    texts = [b"", b"a", bytes(rng.integers(0, 256, Q.CHUNK, np.uint8)), bytes(rng.integers(0, 256, Q.CHUNK + 1, np.uint8)), bytes(rng.integers(0, 256, 3000, np.uint8)), b"\x00" * 700]
    want = [plain_score(net, t) for t in texts]
    for slab in (1, 2, 3, 64):
        monkeypatch.setattr(Q, "SLAB", slab)
        assert np.allclose(net.scores(texts), want, atol=1e-5) and np.allclose([net.score(t) for t in texts], want, atol=1e-5)


def test_chunks_cover_every_byte_and_every_window():
    for size in (0, 1, Q.HOP, Q.CHUNK - 1, Q.CHUNK, Q.CHUNK + 1, Q.CHUNK + Q.HOP, 5000):
        raw = bytes(i % 251 for i in range(size))
        chunks = Q.chunks_of(raw)
        assert len(chunks) == Q.chunk_count(size) and (len(chunks) - 1) * Q.HOP + Q.CHUNK >= size
        for n, c in enumerate(chunks):
            part = raw[n * Q.HOP : n * Q.HOP + Q.CHUNK]
            assert bytes(c[: len(part)].astype(np.uint8)) == part and (c[len(part) :] == Q.PAD).all()
    assert Q.CHUNK - Q.HOP >= Q.WIDTH and Q.HOP % Q.STRIDE == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    net = Q.ByteNet(6)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = [Q.chunks_of(bytes(rng.integers(0, 256, n, np.uint8))) for n in (40, 900, 1500)]
    weights, labels = np.array([0.2, 0.5, 0.3]), np.array([1.0, 0.0, 1.0])
    _, g = net.gradients(texts, weights, labels)
    for name in net.NAMES:
        value = getattr(net, name)
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up, _ = net.gradients(texts, weights, labels)
            value[at] = kept - step
            down, _ = net.gradients(texts, weights, labels)
            value[at] = kept
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def labelled(spark, n=900):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7)))
    rows, labels, quality = [], [], {}
    for i in range(n):
        bad = rng.random() < 0.25
        words = [word() for _ in range(rng.randint(30, 300))]
        if bad:
            start = rng.randrange(len(words))  # somewhere in the text
            words = [w + " |" if start <= j < start + 25 else w for j, w in enumerate(words)]
        rows.append((i, " ".join(words), "l", "s", 0.5))
        quality[i] = 0 if bad else 1
        if i % 3:
            labels.append((i, quality[i], 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (10**6, 0, 0), (0, None, 1), (3, 7, 0)], "doc_id long, quality int, toxic int"), quality


def test_held_out_texts_are_judged_well(spark):
    docs, labels, quality = labelled(spark)
    net = Q.learn(docs, labels, max_docs=400)
    rows = Q.score(docs, net).collect()
    assert len(rows) == len(quality) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [(r.score >= Q.THRESHOLD) == bool(quality[r.doc_id]) for r in rows if r.held_out]
    assert len(out) > 100 and np.mean(out) > 0.95
    again = {r.doc_id: r.score for r in Q.score(docs.repartition(5), Q.learn(docs.repartition(2), labels, max_docs=400)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-5 for r in rows)  # the order of the rows doesn't matter


def test_labels_of_held_out_rows_and_other_columns_are_never_read(spark):
    docs, labels, _ = labelled(spark, 300)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    one, other = Q.learn(docs, labels, rounds=1, least_steps=1), Q.learn(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), turned, rounds=1, least_steps=1)
    assert all(np.array_equal(getattr(one, n), getattr(other, n)) for n in one.NAMES)


def test_defined_cases(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score(docs, Q.learn(docs, none)).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(20)], none.schema)
    assert {r.score for r in Q.score(docs, Q.learn(docs, one_kind)).collect()} == {1.0}
    net = Q.fit_net([b"good text", b"|||||"] * 4, [1, 0] * 4, rounds=2, least_steps=2)
    got = Q.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (140, 141)}
    assert len(blank) == 1  # null and empty alike
    assert Q.score(empty, net).count() == 0 and Q.learn(empty, none).prior == 0.5


def test_a_text_of_a_million_characters_is_scored(spark):
    net = Q.fit_net([b"good text", b"|||||"] * 4, [1, 0] * 4, rounds=2, least_steps=2)
    long = "ab cd é " * 130_000
    got = Q.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), net).first()
    assert abs(got.score - net.score(long.encode())) < 1e-6


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_on_the_tables(spark, sf):
    got = Q.op13_quality_net(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = got.collect()
    hits = [r.predicted == quality[r.doc_id] for r in rows if r.held_out and r.doc_id in quality]
    assert len(rows) == 1000 and np.mean(hits) > 0.9
