"""The pipeline's stages, one after the other, against a plain reading of each; odd rows and columns."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_dedup import near_texts, norm, similarity
from tests.llm.test_quality import brute_stats
from tracklens.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, k string, kept boolean, _row int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folder of documents (extra columns have names that the operators use) and labels."""
    rng = random.Random(11)
    rows = [(i, t) for i, t, _ in near_texts(25, 12, 70, 160)]
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    shared = " ".join(word() for _ in range(60))
    rows += [(1000 + i, " ".join(word() for _ in range(60)) + "\n" + shared) for i in range(5)]
    rows += [(1100, rows[0][1].replace(" ", " \t")), (1101, rows[0][1]), (1102, None), (1103, ""), (1104, "too short"), (1105, "again and again " * 60)]
    rows += [(None, " ".join(word() for _ in range(80))), (None, None), (7000, " ".join(word() for _ in range(90))), (7000, " ".join(word() for _ in range(90)))]
    rows += [(8000, " ".join(word() for _ in range(9000))), (9000, " ".join(word() + "#$%" for _ in range(90)))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "x", False, 3) for i, t in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, 0, 0), *((i, int(i != 9000), 0) for i in {i for i, _ in rows if i is not None})], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def removed(texts):
    """Texts without what a 100-byte string covers that starts earlier."""
    seen, out = set(), []
    for text in texts:
        raw = text.encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        out.append(bytes(c for c, gone in zip(raw, covered) if not gone).decode(errors="ignore"))
    return out


def test_every_stage_matches_a_plain_reading(spark, tables):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    before, after = rows(docs), {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(f(spark, docs, tables), "test")
        assert [c for c in docs.columns if c != "n_chars"] == ["doc_id", "text", "k", "kept", "_row"]
        assert {(r.k, r.kept, r["_row"]) for r in docs.collect()} == {("x", False, 3)}
        after[name] = rows(docs)

    def passes(text):
        n, *_, repeated = brute_stats(text)
        return n >= 50 and 100 * repeated <= 50 * n

    good = [r for r in before if passes(r[1])]
    good = [r for r in good if r[0] != 9000]
    assert after["quality_rules"] == good
    first = {}
    for i, t in good:
        first.setdefault(norm(t), (i, t))
    exact = sorted(first.values(), key=good.index)
    assert after["exact_dedup"] == exact
    near = after["simhash_dedup"]
    gone = [r for r in exact if r not in near]
    assert all(any(similarity(t, u) >= 0.8 for _, u in exact if u != t) for _, t in gone)
    pairs = [(r, s) for n, r in enumerate(exact) for s in exact[:n] if similarity(r[1], s[1]) >= 0.8]
    assert len(pairs) > 10 and sum(r not in near or s not in near for r, s in pairs) >= 0.8 * len(pairs)  # few pairs; test_dedup.py measures recall
    assert [t for _, t in after["suffix_dedup"]] == removed([t for _, t in near])

    packed = corpus_pipeline.packed(spark, docs, tables).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.start, r.ids))
        places[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for i, t in after["suffix_dedup"]:
        if i is not None and i != 7000:
            assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*own.encode(t, add_special_tokens=False).ids, 0]
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert sum(r.piece == 0 for r in packed) == len(after["suffix_dedup"])


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
