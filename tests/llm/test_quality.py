import re

import numpy as np

from tracklens.llm import quality_rules as Q
from tracklens.llm.common import keyed


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_statistics_match_brute_force(spark, docs, rows):
    extra = [(500, "a a a a a", "en"), (501, "x y z x y z w\nx y\nx y\n#$%", "en"), (502, "  a\x0bb\x1cc", "en")]
    more = spark.createDataFrame([(i, t, ) for i, t, _ in [*rows, *extra]], "doc_id long, text string")
    got = Q.document_stats(keyed(more)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(repr((i, *brute_stats(t))) for i, t, _ in [*rows, *extra])


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    scores = Q.IsolationForest(rows, 60, 128, 1).score(rows)
    assert scores[-1] == scores.max() and scores[-1] > 0.7 and np.median(scores) < 0.55


def test_score_is_the_mean_path_length_of_a_walk():
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (200, 3))
    forest = Q.IsolationForest(rows, 7, 64, 3)

    def walk(row):
        total = 0
        for feature, split, left, length in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] + (row[feature[node]] > split[node])
            total += length[node]
        return 2 ** (-total / len(forest.trees) / Q.average_path(forest.size))

    assert np.allclose(forest.score(rows), [walk(r) for r in rows])


def labelled(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 10 == 0
        rows.append((i, " ".join(word() + ("***" if bad else "") for _ in range(rng.integers(60, 120)))))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (9999, None, 1)], "doc_id long, quality int, toxic int")


def test_unlabelled_rows_are_judged_well(spark):
    docs, labels = labelled(spark)
    kept = {r.doc_id: r.kept for r in Q.judge(keyed(docs), labels).collect()}
    assert len(kept) == 400 and all(kept[i] == (i % 10 != 0) for i in range(400))
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}


def test_defined_cases(spark, docs, rows, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.judge(keyed(docs), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert Q.judge(keyed(empty), labels).count() == 0 and Q.keep_good(empty, labels).count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns
