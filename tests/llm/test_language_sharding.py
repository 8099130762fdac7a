import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tracklens.llm import language, sharding
from tracklens.llm.common import components

SF = "/root/testdata/sf0.001"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.predict(docs, language.learn(docs)).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.97


def test_words_first_then_shorter_grams():
    model = language.Model([("a", "tree", 9), ("b", "baum", 9)], [("a", 4, "^tre", 5), ("b", 4, "^bau", 5), ("a", 1, "z", 7), ("b", 1, "z", 1)])
    gram = lambda g: model.gram_logs[model.grams[g]]
    assert np.allclose(model.score_word("tree"), model.word_logs[model.words["tree"]])
    assert np.allclose(model.score_word("tre"), gram("^tre"))  # no other n-gram of it is known
    assert np.allclose(model.score_word("zz"), gram("z"))
    assert not model.score_word("qq").any()


def test_language_cases(spark, docs, rows, empty):
    got = language.predict(docs, language.learn(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred in ("en", "de", "und") and r.held_out == held(r.doc_id)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got}[141] == ("und", 0.0)
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, nothing).count() == 0


def test_learning_reads_neither_held_out_rows_nor_other_columns(spark):
    rows = [(i, "wort " * 3 if i % 2 else "word " * 3, "de" if i % 2 else "en") for i in range(200)]
    spoilt = [(i, "zzz" if held(i) else t, "xx" if held(i) else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (language.learn(spark.createDataFrame(r, schema)) for r in (rows, spoilt))
    assert a.langs == b.langs == ["de", "en"] and a.words == b.words and a.word_logs.tolist() == b.word_logs.tolist()


def test_a_language_of_one_rare_word_is_known(spark):
    ids = [i for i in range(100) if not held(i)]
    rows = [(i, f"some english words number {i}", "en") for i in ids[:20]] + [(ids[20], "omega", "xx"), (ids[21], "omega", None), (ids[22], "हिन्दी में", "hi"), (ids[23], "हिन्दी", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()}
    assert [got[i] for i in ids[19:24]] == ["en", "xx", "xx", "hi", "hi"]
    assert language.words_of("हिन्दी") == ["हिन्दी"]


@pytest.mark.parametrize("seed", [1, 2])
def test_prediction_matches_a_plain_reading(spark, seed):
    """Word-first backoff written out plainly, over all words of all rows."""
    import math
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb", "cc"])
        letters = {"aa": "abcde", "bb": "cdefg", "cc": "efghé"}[lang]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12))), lang))
    learned = [(t, lang) for i, t, lang in rows if not held(i)]
    langs = sorted({lang for t, lang in learned if t})
    words, grams = Counter(), [Counter() for _ in range(5)]
    for t, lang in learned:
        for w in t.split():
            words[w, lang] += 1
            for n in range(1, 5):
                for at in range(len(w) + 3 - n):
                    grams[n][f"^{w}$"[at : at + n], lang] += 1

    totals = {(id(c), lang): sum(c[x, lang] + 0.5 for x in {x for x, _ in c}) for c in (words, *grams) for lang in langs}

    def log(table, item, lang):
        return math.log((table[item, lang] + 0.5) / totals[id(table), lang])

    def score(w, lang):
        if any((w, x) in words for x in langs):
            return log(words, w, lang)
        total, n_places, marked = 0.0, 0, f"^{w}$"
        for at in range(len(marked)):
            for n in (4, 3, 2, 1):
                if at + n <= len(marked) and any((marked[at : at + n], x) in grams[n] for x in langs):
                    total, n_places = total + log(grams[n], marked[at : at + n], lang), n_places + 1
                    break
        return total / max(1, n_places)

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    for i, t, _ in rows[:40]:
        sums = {lang: sum(score(w, lang) for w in t.split()) for lang in langs}
        best = max(sums.values())
        assert (got[i].lang_pred == "und") == (not t)
        if t:
            assert sums[got[i].lang_pred] > best - 1e-3
            assert abs(got[i].score - 1 / sum(math.exp(s - best) for s in sums.values())) < 1e-3


@pytest.mark.parametrize("name", ["docs", "plain"])
def test_shards(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    got = sharding.assign(df, 7).collect()
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count[j] for j in range(7)) <= 1 and set(count) <= set(range(7))
    for j in count:
        assert sorted(r.slot for r in got if r.shard == j) == list(range(count[j]))
    assert sorted(repr((i, len(t.encode()) + 8, zlib.crc32(t.encode()))) for i, t in rows) == sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got)
    parts = {}
    for r in got:
        parts.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert max(map(len, parts.values())) == 1  # no group here exceeds a quota


def test_a_group_over_the_quota_fills_shards(spark):
    df = spark.createDataFrame([(i, "same" if i < 50 else f"pair {i // 2}") for i in range(100)], "doc_id long, text string")
    got = sharding.assign(df, 5).collect()
    assert Counter(r.shard for r in got) == {j: 20 for j in range(5)}
    shard = {r.doc_id: r.shard for r in got}
    print(Counter(shard[i] for i in range(50)), sum(shard[i] != shard[i + 1] for i in range(50, 100, 2)))
    assert max(Counter(shard[i] for i in range(50)).values()) > 10  # dealt evenly it would be 10
    assert sum(shard[i] != shard[i + 1] for i in range(50, 100, 2)) <= 5  # by chance 20 of the 25 pairs


def test_shards_of_nothing(empty):
    assert sharding.assign(empty).count() == 0


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_match_union_find(spark, few):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8), few=few).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(f(spark, docs, SF), "test")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, again.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(repr, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))
