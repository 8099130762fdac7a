import random
import re
from collections import Counter

import duckdb
import pytest

from tracklens.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50):
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(TERM.findall(t.translate(LOWER)), s) for t, l, s in rows if l == lang]
        docs = Counter(w for words, _ in own for w in set(words))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        counts = {s: Counter() for _, s in own}
        for words, s in own:
            counts[s].update(w for w in words if w in set(kept))
        total = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        of, q = {s: p(c) for s, c in counts.items()}, p(total)
        for s in of:
            pairs = [(o, sum(abs(of[s][w] - of[o][w]) for w in kept)) for o in of if o != s]
            terms = [(w, of[s][w] - q[w]) for w in kept if counts[s][w] and of[s][w] > q[w]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:limit])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "Be", "é", "zu", "ß", "Ōk", "日") for b in ("n", "ré", "X", "lu")]
    rows = []
    for i in range(220):
        rows.append((" ".join(rng.choice(words) + rng.choice([" ", "-", "_", "7", "\n", "\x00"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é", "Z"])))
    rows += [rows[0]] * 40 + [(rows[1][0], "en", s) for s in "abcxyz"] * 2  # many copies, over several sources
    rows += [(None, "en", "quiet"), ("", "en", "quiet"), ("12 _", "fr", "only"), ("mot", "fr", "other"), ("\x7f", None, None), ("long " * 40_000, "en", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "t", 1, "v", "r") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, value string, rank string").repartition(4)


@pytest.mark.parametrize("min_docs", [1, 5, 30, 10_000])
def test_audit_matches_brute_force(spark, texts, min_docs):
    got = D.audit(frame(spark, texts), min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(texts, min_docs)


def test_blocks_chunks_slices_and_lists_change_nothing(spark, texts, monkeypatch):
    """Small bounds: sources in several blocks, terms in several chunks, sources of a text in several lists."""
    for name, value in (("SOURCES", 3), ("TERMS", 4), ("BLOCK", 2)):
        monkeypatch.setattr(D, name, value)
    assert sorted(map(tuple, D.audit(frame(spark, texts), 3, top=4).collect())) == brute(texts, 3, top=4)


def test_a_text_is_one_row_with_its_copies(spark, texts):
    docs = frame(spark, texts)
    sources, seed = D.numbered_sources(docs)
    assert {r.source for r in sources.collect()} == {r[2] or "" for r in texts} and sources.select("sid").distinct().count() == sources.count()
    rows = D.collapsed(docs, seed, sources.count()).collect()
    assert len(rows) == len({(r[1] or "", r[0] or "") for r in texts})
    assert sum(c["n"] for r in rows for c in r.copies) == len(texts)
    hot = [r for r in rows if (r.lang, r.text) == (texts[0][1] or "", texts[0][0])]
    assert len(hot) == 1 and max(c["n"] for c in hot[0].copies) >= 41


def test_slices_split_no_term(monkeypatch):
    text = ("ab " * 50 + "x" * 40 + "," + "Éé").encode()
    whole = text.decode().translate(LOWER).replace(",", " ").encode().split()
    for size in (1, 5, 64, 1000):
        monkeypatch.setattr(D, "SLICE", size)
        assert [w for part in D.terms_of(text) for w in part] == whole
    assert list(D.terms_of(b"")) == []


def test_tasks_send_their_sums_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD", 2)
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": b"a b a", "copies": [{"sid": 5, "n": 2}, {"sid": 6, "n": 1}]}, {"lang": "en", "text": b"b c", "copies": [{"sid": 5, "n": 1}]}])
    sums: Counter = Counter()
    for out in D._count([batch]):
        for r in out.to_pylist():
            sums[r["sid"], r["term"], "count"] += r["count"]
            sums[r["sid"], r["term"], "docs"] += r["docs"]
    assert {k: v for k, v in sums.items() if v} == {(5, "a", "count"): 4, (5, "a", "docs"): 2, (5, "b", "count"): 3, (5, "b", "docs"): 3, (6, "a", "count"): 2, (6, "a", "docs"): 1, (6, "b", "count"): 1, (6, "b", "docs"): 1, (5, "c", "count"): 1, (5, "c", "docs"): 1}


def test_sql_and_empty_table(spark, empty):
    assert D.audit(empty.withColumn("source", empty.text)).count() == 0
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, D.op12_source_divergence(spark, sf).collect())) == sorted(con.execute(D.SQL).fetchall())
