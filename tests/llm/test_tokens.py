import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklens.llm import packing, pieces, tokens
from tracklens.llm.common import new_path, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def sentencepiece():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


ODD = ["", " ", "<|endoftext|>a<|endoftext|>", "a" * 20000, " " * 5000, "\n" * 3000 + "x", "été 東京 😀", "it's 12345 !!??", "\x00\x1f", " x y", "é́ñ"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_library(library, text):
    assert tokens.encode(text).tolist() == library(text)


def test_odd_texts(library):
    for text in ODD:
        assert tokens.encode(text).tolist() == library(text)


def test_counts_and_cache(spark, docs, rows, library, empty):
    cache = new_path(spark, "test-cache")
    tokens.open_cache(spark, cache)
    want = sorted(repr((i, len((t or "").encode()), len(library(t)), len(library(t)) > 1024)) for i, t, _ in rows)
    for _ in range(2):
        got = tokens.count_tokens(docs, cache).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
        # the second run finds every digest: nothing is appended
        stored = spark.read.parquet(cache)
        assert stored.select("content").distinct().count() == len({t or "" for _, t, _ in rows})
        assert stored.count() == len({t or "" for _, t, _ in rows})
        size = stored.count()
    spark.createDataFrame([(bytes(32), "another version", 5)], tokens.CACHE).write.mode("append").parquet(cache)
    assert sorted(repr(tuple(r)) for r in tokens.count_tokens(docs, cache).collect()) == want
    assert spark.read.parquet(cache).count() == size + 1
    assert tokens.count_tokens(empty, cache).count() == 0


def test_repeated_rows_are_encoded_once(spark):
    cache = new_path(spark, "test-cache")
    tokens.open_cache(spark, cache)
    for i in (7, None):
        df = spark.createDataFrame([(i, f"the same text {i}")] * 1000, "doc_id long, text string").repartition(8)
        assert tokens.count_tokens(df, cache).count() == 1000
    assert spark.read.parquet(cache).count() == 2


def test_version_covers_all_that_encodes(monkeypatch, tmp_path):
    import public_tokenizers

    names = [f"{tokens.VOCABULARY}.{x}" for x in ("json", "tiktoken")]
    for n in names:
        (tmp_path / n).write_bytes(open(tokenizer_path(n), "rb").read())
    before = {tokens.version(), tokens.version(str(tmp_path))}
    assert len(before) == 1
    for n in names:
        whole = (tmp_path / n).read_bytes()
        (tmp_path / n).write_bytes(whole + b"\n")
        assert tokens.version(str(tmp_path)) not in before
        (tmp_path / n).write_bytes(whole)
    monkeypatch.setattr(public_tokenizers, "PATTERN", public_tokenizers.PATTERN + "|x")
    assert tokens.version() not in before


def test_ids_of_whole_documents(library, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in docs[::5]] + ["".join(r.text or "" for r in docs[:40])]  # one of many languages
    for text in texts:
        assert tokens.encode(text or "").tolist() == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abtheE.,'s1é的"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_transducer_gives_the_library_ids(sentencepiece, text):
    t = pieces.transducer()
    ids = t.encode(text)
    assert ids == sentencepiece.encode(text)
    assert t.decode(ids) == sentencepiece.decode(ids)
    if pieces.MARK not in text:
        assert t.decode(ids) == text


def test_runs_of_spaces(sentencepiece):
    t = pieces.transducer()
    for n in range(70):
        for text in (" " * n, "a" + " " * n, " " * n + "b", "的" + " " * n + "的"):
            assert t.encode(text) == sentencepiece.encode(text)


def test_neighbours_agree_with_merging():
    t = pieces.transducer()
    rng = np.random.default_rng(7)
    for a, b in rng.integers(0, len(t.words), (3000, 2)):
        x, y = t.words[a], t.words[b]
        if pieces.MARK not in y and x.strip(pieces.MARK):
            assert (t.link(int(a), int(b)) == 0) == (t.merges(x + y)[0] == [x, y])


def every_path(t, text):
    """All paths through the lattice of a normalised text as (weight, pieces and characters)."""
    paths = [[(0.0, (), -1)]]
    for end in range(1, len(text) + 1):
        here = [(w + pieces.FALLBACK * len(text[end - 1].encode()), (*p, text[end - 1]), -1) for w, p, _ in paths[end - 1]]
        for start, piece in [(e + 1 - size, p) for e, (size, p) in t.pieces.arcs(text) if e + 1 == end]:
            here += [(w + pieces.PIECE + t.link(a, piece), (*p, t.words[piece]), piece) for w, p, a in paths[start]]
        paths.append([x for x in here if x[0] < pieces.NEVER])
    return paths[-1]


def test_shortest_path_is_the_least_of_all_paths(sentencepiece):
    t = pieces.transducer()
    for text in ("▁the", "▁token", "thers", "▁ab的c", "aaab", "▁inter"):
        weight, path, _ = min(every_path(t, text))
        ids = [i for p in path for i in ([t.ids[p]] if p in t.ids else [t.byte_ids[b] for b in p.encode()])]
        assert list(t.shortest_path(text)) == ids
        assert sum(w == weight for w, *_ in every_path(t, text)) == 1
        if text[0] == pieces.MARK:
            assert ids == sentencepiece.encode(text[1:])


def test_normaliser_writes_marks():
    n = pieces.Normaliser()
    assert n.compose("a b▁\n") == "▁a▁b▁\n" and n.compose("") == "▁"


def test_whole_documents_encode_as_in_the_library(sentencepiece, spark):
    t = pieces.transducer()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    for text in [r.text or "" for r in docs[::4]] + ["".join(r.text or "" for r in docs[:30]), "ab" * 50_000, "x " * 50_000]:
        assert t.encode(text) == sentencepiece.encode(text)


def test_piece_queries(docs, rows, sentencepiece, empty):
    got = pieces.piece_digests(docs).collect()
    crc = lambda t: zlib.crc32(np.array(sentencepiece.encode(t or ""), "<u4").tobytes())
    assert sorted(repr((r.doc_id, r.n_pieces, r.ids_crc32, r.round_trip)) for r in got) == sorted(repr((i, len(sentencepiece.encode(t or "")), crc(t), True)) for i, t, _ in rows)
    back = pieces.decode_texts(pieces.encode_texts(docs)).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr((i, t or "")) for i, t, _ in rows)
    assert pieces.piece_digests(empty).count() == 0 and pieces.encode_texts(empty).count() == 0


def check_packing(got, wanted, capacity):
    """wanted: multiset of (doc_id, ids with the end token)."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    digests = Counter()
    for i, ids in wanted:
        for n, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            digests[i, n, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            assert length == capacity or n == 0
    assert digests == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    return len(sequences)


@pytest.mark.parametrize("name", ["docs", "plain"])
def test_packing(name, request, library):
    df = request.getfixturevalue(name)
    wanted = [(r.doc_id, [*library(r.text), 0]) for r in df.select("doc_id", "text").collect()]
    for capacity in (2048, 300):
        n = check_packing(packing.pack(df, capacity).collect(), wanted, capacity)
        lengths = Counter(length for _, ids in wanted for _, length in packing.cut(len(ids), capacity))
        full = lengths.pop(capacity, 0)
        assert n - full <= packing.lower_bound(lengths, capacity) + 1


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def exact_bins(sizes, capacity):
    """Fewest bins, by trying all."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=9))
def test_bins_are_as_few_as_can_be(sizes):
    sizes = sorted(sizes, reverse=True)
    packer = packing.Packer(dict(Counter(sizes)), 20)
    assert Counter(x for times, bin_ in packer.bins for x in bin_ for _ in range(times)) == Counter(sizes)
    assert all(sum(bin_) <= 20 for _, bin_ in packer.bins)
    assert packer.bound <= exact_bins(sizes, 20) == packer.size() and packer.optimal


def test_many_short_pieces_are_packed():
    packer = packing.Packer({5: 409 * 2100, 2: 1023 * 2100})
    assert packer.size() == packer.bound and sum(times * len(bin_) for times, bin_ in packer.bins) == (409 + 1023) * 2100


def test_search_beats_best_fit_decreasing():
    import random

    better = 0
    for seed in range(30):
        rng = random.Random(seed)
        counts = dict(Counter(rng.randint(20, 70) for _ in range(40)))
        best_fit = sum(times for times, _ in packing.best_fit_decreasing(counts, 100))
        packer = packing.Packer(counts, 100, nodes=100_000)
        assert packer.bound <= packer.size() <= best_fit
        better += packer.size() < best_fit
    assert better > 3


def test_all_pieces_are_packed_when_the_search_ends_early():
    import random

    rng = random.Random(2)
    counts = dict(Counter(rng.randint(500, 899) for _ in range(500)))
    packer = packing.Packer(counts, nodes=50)
    assert not packer.optimal and Counter(x for times, bin_ in packer.bins for x in bin_ for _ in range(times)) == counts
