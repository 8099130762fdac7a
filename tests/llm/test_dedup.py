import hashlib
import re
from collections import defaultdict

import pytest

from tracklens.llm import exact_dedup, line_dedup, simhash_dedup, suffix_dedup
from tracklens.llm.common import keyed


def ordered(df):
    """(k, doc_id, text) by a plain reading of the key's definition."""
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    return rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("name", ["docs", "plain"])
def test_keys_are_unique_and_in_order(name, request):
    df = request.getfixturevalue(name)
    got = sorted((r.k, r.doc_id, r.text) for r in keyed(df).collect())
    assert len({k for k, _, _ in got}) == len(got)
    assert [g[1:] for g in got] == ordered(df)


@pytest.mark.parametrize("name", ["docs", "plain"])
def test_exact_groups_match_brute_force(name, request):
    df = request.getfixturevalue(name)
    groups = defaultdict(list)
    for i, text in ordered(df):
        groups[norm(text)].append(i)
    want = sorted(((i, g[0], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=repr)
    got = exact_dedup.exact_groups(df, capacity=8).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {k: v for k, v in kept.items()} == {hashlib.sha256(t.encode()).hexdigest(): g[:1] for t, g in groups.items()}


def test_directory_doubles_until_buckets_fit():
    d = exact_dedup.Directory({p: 3 for p in range(0, 1 << 14, 64)}, 10, 14)
    assert d.depth > 0 and max(d.buckets.values()) <= 10
    assert sum(1 << (d.depth - depth) for depth, _ in d.buckets) == 1 << d.depth
    one = exact_dedup.Directory({5: 1000}, 10, 14)  # a single prefix can't split
    assert max(one.buckets.values()) == 1000 and one.depth == 14


def test_directory_of_entries_has_several_buckets_a_partition(spark):
    from pyspark.sql import functions as F

    entries = spark.range(5000).select(F.xxhash64("id").alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = exact_dedup.directory_of(entries, None)
    assert len(even.buckets) >= exact_dedup.BUCKETS * n and max(even.buckets.values()) <= -(-5000 // (exact_dedup.BUCKETS * n))
    assert max(exact_dedup.directory_of(entries, 40).buckets.values()) <= 40


def test_exact_dedup_keeps_whole_rows(docs, rows):
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t, _ in rows})


def brute_fingerprint(text, width=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["docs", "plain"])
def test_simhash_components_match_brute_force(name, request):
    df = request.getfixturevalue(name)
    rows = [(i, brute_fingerprint(t)) for i, t in ordered(df)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = sorted(((i, f"{f:016x}", rows[find(n)][0]) for n, (i, f) in enumerate(rows)), key=repr)
    got = simhash_dedup.simhash_components(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_covering_masks_meet_every_pair_within_the_radius():
    from itertools import combinations

    masks = simhash_dedup.masks(3)
    for bits in list(combinations(range(64), 3)):
        flip = sum(1 << b for b in bits)
        assert any(not flip & m for m in masks)


def test_second_tables_meet_every_pair_within_the_radius():
    import random

    first, every = simhash_dedup.masks(3), simhash_dedup.every_mask(3)
    assert len(every) == 15 + 15 * 15 and all(64 - m.bit_count() <= 16 for m in every[15:])
    rng = random.Random(1)
    for v, mask in enumerate(first):
        subs = every[15 + 15 * v : 30 + 15 * v]
        free = [i for i in range(64) if not mask >> i & 1]
        assert all(m & mask == mask for m in subs)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(free, 3))
            assert any(not flip & m for m in subs)


@pytest.mark.parametrize("limit", [3, 1 << 16])
def test_buckets_dealt_again_lose_no_link(spark, limit):
    import random

    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for base in list(fps)[:5]:
        for _ in range(30):
            near = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                near ^= 1 << b
            fps.add(near)
    fps = sorted(fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(k, k, simhash_dedup._signed(f)) for k, f in enumerate(fps)], "k long, doc_id long, fp long")
    got = {r.fp: r.root for r in simhash_dedup.near_components(df, 3, limit).collect()}
    want = {simhash_dedup._signed(f): find(k) for k, f in enumerate(fps) if sum(find(j) == find(k) for j in range(len(fps))) > 1}
    assert got == want


def test_large_buckets_are_searched_by_neighbours():
    import numpy as np

    rng = np.random.default_rng(1)
    base, free = np.uint64(12345), (1 << 12) - 1
    fps = np.unique(base ^ rng.integers(0, 1 << 12, 900).astype(np.uint64))
    pairs = {(a, b) for x, y in simhash_dedup.bucket_links(fps, free, 3) for a, b in zip(x.tolist(), y.tolist()) if a < b}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert len(fps) > 299 and pairs == want  # 299 flips of 12 bits: the lookup path


def near_texts(n, seed, least=40, most=400):
    """Texts and, for each, copies with some words changed; [(id, text, id of the original)]."""
    import random

    rng = random.Random(seed)
    frequent = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(20)]
    word = lambda: rng.choice(frequent) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(least, most))]
        out.append((10 * i, " ".join(words), 10 * i))
        for c in range(i % 4):
            copy = list(words)
            for _ in range(max(1, int(len(words) * rng.uniform(0.002, 0.04)))):
                copy[rng.randrange(len(copy))] = word()
            out.append((10 * i + 1 + c, " ".join(copy), 10 * i))
    return out


def similarity(x, y, width=5):
    sets = []
    for text in (x, y):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    a, b = sets
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_found_and_other_texts_stay(spark):
    rows = near_texts(300, 3)
    kept = {r.doc_id for r in simhash_dedup.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)).collect()}
    groups = defaultdict(list)
    for i, text, base in rows:
        groups[base].append((i, text))
    pairs = found = 0
    for members in groups.values():
        linked = {i: {j for j, u in members if j != i and similarity(t, u) >= 0.8} for i, t in members}
        assert all(i in kept for i, near in linked.items() if not near)
        assert any(i in kept for i, _ in members)
        for i, t in members:
            for j in linked[i]:
                pairs += i < j
                found += i < j and j not in kept
    assert pairs > 200 and found >= 0.9 * pairs


@pytest.mark.parametrize("block", [7, 4096])
def test_no_link_within_the_radius_is_lost(spark, block):
    """One large group whose members are alike only in part, against all pairs."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, t) for i, t, _ in near_texts(20, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {i: simhash_dedup.word_fingerprint(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, t in rows:  # all pairs
        for b, u in rows:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 6 and similarity(t, u) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in root if any(find(j) == find(i) for j in root if j != i)}
    assert {r.node: r.root for r in simhash_dedup.near_copies(keyed(df), block=block).collect()} == want


@pytest.mark.parametrize("block", [16, 4096])
def test_pairs_of_one_large_bucket_are_all_found(spark, block):
    """120 pairs of texts, all of the same words in other orders: one fingerprint, blocks larger than their mean."""
    import random

    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(120):
        one = rng.sample(words, 120)
        other = list(one)
        at = rng.randrange(119)
        other[at], other[at + 1] = other[at + 1], other[at]  # six of 116 shingles change
        rows += [(i, " ".join(one)), (1000 + i, " ".join(other))]
    got = simhash_dedup.near_copies(keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), block=block)
    assert {r.node: r.root for r in got.collect()} == {i: i % 1000 for i, _ in rows}


def test_every_table_of_near_copies_keeps_half_of_the_bits():
    """A table that keeps few bits puts unrelated texts into one bucket, whose pairs grow with the square of the input."""
    import random

    masks = simhash_dedup.masks(6)
    assert len(masks) == 127 and min(m.bit_count() for m in masks) >= 32
    rng = random.Random(2)
    for _ in range(5000):
        flip = sum(1 << b for b in rng.sample(range(64), 6))
        assert any(not flip & m for m in masks)


def test_many_edited_copies_of_a_text_take_few_pairs(spark, monkeypatch):
    """300 copies of a text, most of them too far apart from each other: pairs whose texts are compared, and the components."""
    import random

    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0, 12)):
            copy[at] = base[rng.randrange(150)]
        rows.append((i, " ".join(copy)))
    seen, verified = [], simhash_dedup._verified
    monkeypatch.setattr(simhash_dedup, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    got = {r.node: r.root for r in simhash_dedup.near_copies(keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()}
    fps = [simhash_dedup.word_fingerprint(t) for _, t in rows]
    sets = [set(zip(*(t.split()[n:] for n in range(5)))) for _, t in rows]
    root, links, near = list(range(300)), 0, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(300):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 6:
                near += 1
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    links += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(300) if any(find(j) == find(i) for j in range(300) if j != i)}
    assert near > 5 * 300 and sum(seen) < 4 * 300


def test_sketches_of_near_copies_differ_in_few_bits():
    import numpy as np

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    texts, bits = [" ".join(words)], []
    for at in range(60):
        copy = list(words)
        for i in rng.choice(400, 4 + at % 6, replace=False):
            copy[i] = "x"
        texts.append(" ".join(copy))
    sets = [np.unique(simhash_dedup.shingle_hashes(t, 5)) for t in texts]
    odd = [np.bincount((h >> np.uint64(55)).astype(int), minlength=512) % 2 for h in sets]
    for h, o in zip(sets[1:], odd[1:]):
        if len(np.intersect1d(h, sets[0])) >= 0.8 * len(np.union1d(h, sets[0])):
            bits.append((o != odd[0]).sum() <= simhash_dedup.most_apart(np.array([len(h) + len(sets[0])]), 0.8)[0])
    assert len(bits) > 20 and all(bits)
    unrelated = np.bincount(rng.integers(0, 512, 396), minlength=512) % 2
    assert (unrelated != odd[0]).sum() > simhash_dedup.most_apart(np.array([792]), 0.8)[0]


def test_near_dedup_of_odd_rows(spark, docs, rows, empty):
    out = simhash_dedup.dedup(docs)
    assert out.columns == docs.columns
    kept = [r.text for r in out.collect()]
    assert sum(not norm(t).strip() for t in kept) == 1  # texts without words are alike
    assert {norm(t) for t in kept} <= {norm(t) for _, t, _ in rows} and len(kept) < len(rows)
    assert simhash_dedup.dedup(empty).count() == 0
    long_ = [(1, "word " * 200_000 + "end"), (2, "word " * 200_000 + "end"), (3, "x" * 1_000_000)]
    assert sorted(r.doc_id for r in simhash_dedup.dedup(spark.createDataFrame(long_, "doc_id long, text string")).collect()) == [1, 3]


def brute_removed(texts):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, gone in zip(raw, covered) if not gone)
        runs = sum(1 for i, gone in enumerate(covered) if gone and (i == 0 or not covered[i - 1]))
        out.append((len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("name", ["docs", "plain"])
@pytest.mark.parametrize("hot", [1, 1000])
def test_repeated_strings_match_brute_force(name, hot, request, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df = request.getfixturevalue(name)
    rows = ordered(df)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute_removed([t for _, t in rows]))), key=repr)
    got = suffix_dedup.removal_digests(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_anchors_in_pieces_match_anchors_of_whole_texts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))

    def strings(chunk):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        rows = np.concatenate([suffix_dedup.anchors(*p) for p in suffix_dedup._pieces([text], [1])])
        return {(int(r["a"]) - o, int(r["a"])) for r in rows for o in range(int(r["lo"]), int(r["hi"]) + 1)}

    assert strings(700) == strings(1 << 20) and len(strings(700)) == 4901


def test_owner_that_holds_too_many_rows_loses_nothing(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    kind = suffix_dedup._types()[0]
    rows = np.zeros(400, kind)
    rows["h"], rows["c"], rows["k"], rows["a"], rows["hi"] = rng.integers(0, 9, 400), rng.integers(0, 4, 400), rng.permutation(400), 200, 5
    first = {}
    for r in rows:
        first.setdefault((int(r["h"]), int(r["c"])), []).append(int(r["k"]))

    def run(held):
        monkeypatch.setattr(suffix_dedup, "HELD", held)
        import pyarrow as pa

        data = [rows[i : i + 20].tobytes() for i in range(0, 400, 20)]
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 20, pa.int32()), pa.array([suffix_dedup.INDEX] * 20, pa.int32()), pa.array(data, pa.binary())], ["target", "kind", "data"])
        asked, ranges = set(), set()
        for out in suffix_dedup._compare_contexts(3)(iter([batch])):
            for what, raw in zip(out.column("kind").to_pylist(), out.column("data").to_pylist()):
                if what == suffix_dedup.REQUEST:
                    asked |= {int(r["k"]) for r in np.frombuffer(raw, suffix_dedup._types()[1])}
                else:
                    ranges |= {int(r["k"]) for r in np.frombuffer(raw, suffix_dedup._types()[3])}
        return asked, ranges

    for held in (10**6, 50):
        asked, ranges = run(held)
        assert asked | ranges == set(range(400))
        assert all(min(ks) in asked and min(ks) not in ranges for ks in first.values())


def requests_of(monkeypatch, held, rows, step=20):
    """(all requests, all ranges) of one owner that holds at most ``held`` rows."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HELD", held)
    _, request, _, span = suffix_dedup._types()
    data = [rows[i : i + step].tobytes() for i in range(0, len(rows), step)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(data), pa.int32()), pa.array([suffix_dedup.INDEX] * len(data), pa.int32()), pa.array(data, pa.binary())], ["target", "kind", "data"])
    asked, ranges = [], []
    for out in suffix_dedup._compare_contexts(3)(iter([batch])):
        for what, raw in zip(out.column("kind").to_pylist(), out.column("data").to_pylist()):
            if what == suffix_dedup.REQUEST:
                asked += np.frombuffer(raw, request).tolist()
            else:
                ranges += np.frombuffer(raw, span).tolist()
    return sorted(asked), sorted(ranges)


def grams(n, several=9, contexts=40):
    """n anchors: half of few grams with many contexts, half of grams seen once."""
    import numpy as np

    rng = np.random.default_rng(6)
    rows = np.zeros(n, suffix_dedup._types()[0])
    rows["h"] = np.where(rng.random(n) < 0.5, rng.integers(0, several, n), rng.permutation(n) + 1000)
    rows["c"], rows["k"], rows["a"], rows["hi"] = rng.integers(0, contexts, n), rng.permutation(n), 200, 5
    return rows


@pytest.mark.parametrize("held", [5, 50, 300])
def test_owner_that_holds_few_rows_sends_each_request_once(held, monkeypatch):
    asked, _ = requests_of(monkeypatch, held, grams(2000))
    assert len({a[0] for a in asked}) == len(asked) > 100


@pytest.mark.parametrize("hot", [30, 1000])
@pytest.mark.parametrize("held", [5, 50, 300])
def test_route_of_a_gram_does_not_depend_on_rows_held(held, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = grams(2000)
    whole = requests_of(monkeypatch, 10**6, rows)
    assert requests_of(monkeypatch, held, rows) == whole
    routes = defaultdict(set)
    for _, h, *_, is_hot in whole[0]:
        routes[h].add(is_hot)
    assert {len(r) for r in routes.values()} == {1}


def test_passage_whose_copies_come_far_apart_goes(spark, monkeypatch):
    """A gram with two contexts at first, and a copy of one of them when the owner has let go of its first rows."""
    import random

    monkeypatch.setattr(suffix_dedup, "HELD", 20)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(100)
    texts = [word(60) + passage + word(60) for _ in range(2)] + [word(400) for _ in range(40)] + [passage, word(60) + passage + word(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = suffix_dedup.removal_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(i, *x) for i, x in enumerate(brute_removed(texts))]


@pytest.mark.parametrize("hot", [1, 1000])
@pytest.mark.parametrize("held", [5, 60])
def test_repeated_strings_match_brute_force_when_owners_hold_few_rows(held, hot, spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # many arrays for each owner
    try:
        got = suffix_dedup.removal_digests(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = ordered(docs)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute_removed([t for _, t in rows]))), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_deep_shallow_order_is_lexicographic():
    import numpy as np

    rng = np.random.default_rng(3)
    strings = rng.integers(97, 99, (300, 100), dtype=np.uint8)
    strings[:200, :60] = strings[0, :60]  # long common prefixes: the tries' share
    strings[50] = strings[51]
    groups = rng.integers(0, 3, 300)
    order = suffix_dedup.deep_shallow_order(groups, strings)
    keys = [(int(groups[i]), strings[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))


def test_suffix_dedup_returns_texts(docs):
    out = suffix_dedup.dedup(docs)
    rows = ordered(docs)
    assert out.columns == docs.columns
    want = defaultdict(int)
    for (i, t), (_, removed, _, _) in zip(rows, brute_removed([t for _, t in rows])):
        if not removed:
            want[i, t] += 1
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.text] += 1
    assert all(got[key] >= n for key, n in want.items()) and out.count() == len(rows)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(texts, least=10):
    earlier, out = [], []
    for text in texts:
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            if not line.strip(" \t\n\x0b\x0c\r"):
                continue
            if any(line == e or (len(line) >= least and len(e) >= least and within_one(line, e)) for e in earlier):
                gone.append(n)
            earlier.append(line)
        out.append(gone)
    return out


def test_lines_match_brute_force(spark, docs, rows):
    import random

    rng = random.Random(9)
    lines = [f"a line with words number {i}" for i in range(12)] + ["short one", "shart one", "été à la plage là", "ete à la plage là"]
    more = []
    for i in range(40):
        own = rng.sample(lines, 4)
        edit = list(own[0])
        edit[rng.randrange(len(edit))] = rng.choice(["", "z", "zz"])
        more.append((i, "\n".join([*own, "".join(edit), ""])))
    for df in (spark.createDataFrame(more, "doc_id long, text string"), docs):
        ordered_rows = ordered(df)
        want = sorted(((i, len(t.split("\n")) if t else 0, ",".join(map(str, g))) for (i, t), g in zip(ordered_rows, brute_lines([t for _, t in ordered_rows]))), key=repr)
        got = line_dedup.line_report(df).collect()
        assert sorted(((r.doc_id, r.n_lines, r.dropped) for r in got), key=repr) == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    for (i, t), gone in zip(more, brute_lines([t for _, t in more])):
        assert kept[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)


def test_line_dedup_plan_has_no_python(plain):
    plan = line_dedup.line_report(plain)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    assert simhash_dedup.simhash_components(empty).count() == 0
    assert suffix_dedup.removal_digests(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0
    assert line_dedup.line_report(empty).count() == 0
