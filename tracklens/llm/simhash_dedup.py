"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: A-Z in lower case; words are runs of other than ASCII white space; shingles of ``width``
words, repeats included (fewer words: the whole sequence). A bit is set if it is set in over half of the
shingles' XXH64 values (seed 42). A text without words has fingerprint zero.

Links: fingerprints that differ in at most ``radius`` bits. Every bit i gets a vector m(i) in
{1 .. 2**(radius+1) - 1}; table v keeps the bits with an odd number of common ones in m(i) and v. Of any
``radius`` bits there is a v != 0 that is orthogonal to all their vectors, so two fingerprints within the
radius agree on all that table v keeps: every such pair meets in one of the 2**(radius+1) - 1 tables.

A bucket of a table yields no pairs, only a spanning forest of the links between its fingerprints (equal
fingerprints were one row before). A large bucket is not compared all against all: each of its
fingerprints looks up its neighbours within the radius on the bits the table leaves out, so the work of a
bucket is bounded by its size times a constant. Fingerprints of a bucket over LIMIT are dealt again, by a covering
of the 32 bits that its table leaves out: every pair within the radius meets again, and as half of those bits are
kept, no bucket holds more than 2**16 different fingerprints. Components are built from those forests.

``dedup`` removes near copies: texts whose distinct shingles of ``WIDTH`` (5) words have a Jaccard similarity of
``SIMILARITY`` (0.8) or more. Candidates come from the same covering tables, over fingerprints of a text's
distinct words, which an edit moves less than it moves shingles: of pairs at 0.8 or more 95 % differ in at
most ``RADIUS`` (6) bits. A first pass over the tables only finds the rows that have another within the radius,
whose shingles' fingerprints aren't FAR apart. Those rows get a sketch of their shingles, and the tables are read three
times more: by ``CLOSE`` (3) bits and by the whole radius each row proposes its most similar row of another component; then
all pairs of different components are proposed that the sketches don't rule out. Every link is verified on the
shingles themselves. So a group of near copies takes a few links a row, and the pairs that are left are those between
components whose similarity is just below the bound.

Defined results: a null text counts as empty; a null doc_id sorts first; texts without words are alike;
texts are read whole, however long; an empty table gives an empty result; other columns are ignored by
``simhash_components`` and pass through ``dedup``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import components, keyed, partitions, stage, table

BITS = 64
#: What makes a near copy for ``dedup``, and the radius of its candidate search.
WIDTH, SIMILARITY, RADIUS = 5, 0.8, 6
#: Radius of the first links.
CLOSE = 3
#: Rows of a bucket that meet in one task; larger buckets meet block by block.
BLOCK = 4096
#: Different fingerprints that a bucket of the first tables holds before it is dealt again.
LIMIT = 1 << 16
#: Bits by which the shingles' fingerprints of a candidate pair may differ: at a similarity of 0.8 they differ in 9.4 of 64 on
#: average (2.8 either way), those of unrelated texts in 32 (4 either way).
FAR = 20
#: Bits of a sketch of shingles, and the standard deviations that a pair of near copies may lie above its mean.
SKETCH, BEYOND = 512, 4


def masks(radius: int) -> list[int]:
    """The covering tables' masks over 64 bits."""
    n = 1 << (radius + 1)
    # more vectors than bits: of the half with the highest bit set, so that every table keeps 32 bits or all of them (radius 6)
    vector = [i % (n - 1) + 1 if n <= BITS else n // 2 + 37 * i % (n // 2) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, n)]


def sub_masks(mask: int, radius: int) -> list[int]:
    """Covering masks that keep the bits of a mask and, of the others, what the covering of those alone keeps."""
    n = 1 << (radius + 1)
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << b for j, b in enumerate(free) if ((j % (n - 1) + 1) & v).bit_count() % 2) for v in range(1, n)]


def shingle_hashes(text: str | None, width: int):
    """XXH64 (seed 42) of each shingle of a text, as uint64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower() maps A-Z only, split() takes ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def word_fingerprint(text: str | None) -> int:
    """Fingerprint of the distinct words of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = set((text or "").encode().lower().split())
    return majority(np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)))


def word_and_shingle_fingerprints(docs_keyed: DataFrame, width: int) -> DataFrame:
    """(k, fp, sfp): fingerprints of distinct words and of shingles, as signed longs."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            both = [np.fromiter((f(t) for t in texts), np.uint64, len(texts)).view(np.int64) for f in (word_fingerprint, lambda t: fingerprint(t, width))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *map(pa.array, both)], ["k", "fp", "sfp"])

    return docs_keyed.select("k", "text").mapInArrow(of, "k long, fp long, sfp long")


def majority(h) -> int:
    """The bits that over half of the hashes have set."""
    import numpy as np

    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs_keyed: DataFrame, width: int | None = 3) -> DataFrame:
    """(k, doc_id, fp) with the fingerprint's 64 bits as a signed long; without width, of distinct words."""
    bits_of = word_fingerprint if width is None else lambda text: fingerprint(text, width)

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.fromiter((bits_of(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), pa.array(fp.view(np.int64))], ["k", "doc_id", "fp"])

    return docs_keyed.select("k", "doc_id", "text").mapInArrow(of, "k long, doc_id long, fp long")


def bucket_links(fps, free_mask: int, radius: int, block: int = 1024):
    """Links within a bucket as pairs of positions, enough of them to connect whatever is connected.

    Small buckets compare block against block. In others each fingerprint looks up all its neighbours
    within the radius; only the bits in free_mask can differ.
    """
    import numpy as np

    n = len(fps)
    free = [1 << i for i in range(BITS) if free_mask >> i & 1]
    flips = 1 + len(free) + len(free) * (len(free) - 1) // 2 + len(free) * (len(free) - 1) * (len(free) - 2) // 6
    if n <= flips:
        for a in range(0, n, block):
            for b in range(a, n, block):
                x, y = np.nonzero(np.bitwise_count(fps[a : a + block, None] ^ fps[None, b : b + block]) <= radius)
                yield x + a, y + b
        return
    order = np.argsort(fps)
    ordered = fps[order]

    def flip(at: int, mask: int, left: int):
        for i in range(at, len(free)):
            yield mask | free[i]
            if left > 1:
                yield from flip(i + 1, mask | free[i], left - 1)

    for mask in flip(0, 0, radius):
        other = ordered ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(ordered, other), n - 1)
        hit = np.nonzero(ordered[at] == other)[0]
        yield order[hit], order[at[hit]]


def every_mask(radius: int) -> list[int]:
    """The masks of the first tables, then those of the second tables of each."""
    first = masks(radius)
    return first + [m for mask in first for m in sub_masks(mask, radius)]


def _forest(radius: int):
    """Rows (table, key, fp, k) in the order of (table, key): gives the bucket's spanning links (a, b) over k."""
    tables = every_mask(radius)

    def links(v, fps, ks):
        import numpy as np

        up = list(range(len(ks)))

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in bucket_links(np.array(fps, np.int64).view(np.uint64), ~tables[v] & (1 << BITS) - 1, radius):
            for a, b in zip(x.tolist(), y.tolist()):
                if a != b and (a := find(a)) != (b := find(b)):
                    up[max(a, b)] = min(a, b)
                    yield ks[max(a, b)], ks[min(a, b)]

    def of(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

        now, fps, ks = None, [], []
        for batch in batches:
            rows = []
            for v, key, fp, k in zip(*(batch.column(c).to_pylist() for c in ("v", "key", "fp", "k")), strict=True):
                if (v, key) != now:
                    if len(ks) > 1:
                        rows += links(now[0], fps, ks)
                    now, fps, ks = (v, key), [], []
                fps.append(fp)
                ks.append(k)
            yield out(rows)
        if len(ks) > 1:
            yield out(list(links(now[0], fps, ks)))

    return of


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def near_components(fps: DataFrame, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """(fp, root): for fingerprints linked to another, the smallest k of their component. ``fps``: staged (k, doc_id, fp)."""
    one = stage(fps.groupBy("fp").agg(F.min("k").alias("k")), "fingerprints")
    n = len(masks(radius))
    bits = F.lit([_signed(m) for m in every_mask(radius)])
    kept = lambda v: F.col("fp").bitwiseAND(F.element_at(bits, v + 1)).alias("key")
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = one.select("fp", "k", each.alias("v")).select("v", kept(F.col("v")), "fp", "k")
    if one.count() > limit:
        large = stage(rows.groupBy("v", "key").count().where(F.col("count") > limit).select("v", "key"), "large")
        if not large.isEmpty():
            again = rows.join(large, ["v", "key"], "left_semi").select("fp", "k", "v", each.alias("w")).select((n + F.col("v") * n + F.col("w")).alias("v"), "fp", "k")
            rows = rows.join(large, ["v", "key"], "left_anti").union(again.select("v", kept(F.col("v")), "fp", "k"))
    dealt = rows.repartition(partitions(fps.sparkSession), "v", "key").sortWithinPartitions("v", "key")
    edges = dealt.select("v", "key", "fp", "k").mapInArrow(_forest(radius), "a long, b long")
    return components(edges).join(one, F.col("node") == F.col("k")).select("fp", "root")


def near_groups(docs_keyed: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(k, doc_id, fp, root): root is the smallest k that links reach from the row."""
    fps = stage(fingerprints(docs_keyed, width), "simhash")
    roots = near_components(fps, radius)
    alone = fps.groupBy("fp").agg(F.min("k").alias("first"))
    linked = alone.join(roots, "fp", "left").select("fp", F.coalesce("root", "first").alias("root"))
    # staged, so that plain tables meet here: AQE can split a fingerprint with very many rows
    return fps.join(stage(linked, "roots"), "fp")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    found = stage(near_groups(keyed(docs), width, radius), "groups")
    ids = found.where(F.col("k") == F.col("root")).select("root", F.col("doc_id").alias("component_id"))
    return found.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketched_sets(docs_keyed: DataFrame, width: int) -> DataFrame:
    """(k, size, sketch, shingles): the distinct hashes of a text's shingles, their number and their odd sketch.

    A bit of the sketch tells whether an odd number of hashes falls on it, so the bits in which two sketches differ are
    those of the shingles that only one of the texts has.
    """

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), width)) for x in batch.column("text")]
            odd = [np.packbits(np.bincount((h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) % 2 == 1).tobytes() for h in sets]
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array(odd, pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], ["k", "size", "sketch", "shingles"])

    return docs_keyed.select("k", "text").mapInArrow(of, "k long, size long, sketch binary, shingles array<long>")


def most_apart(sizes, similarity: float):
    """Bits in which the sketches of near copies differ at most, by the sum of their sets' sizes."""
    import numpy as np

    only_one = sizes * (1 - similarity) / (1 + similarity)
    mean = SKETCH * (1 - np.exp(-2 * only_one / SKETCH)) / 2
    spread = SKETCH * (1 - np.exp(-4 * only_one / SKETCH)) / 4 - only_one * np.exp(-4 * only_one / SKETCH)
    return mean + BEYOND * np.sqrt(np.maximum(spread, 0)) + 1


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets are alike enough."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stage(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def _in_tables(rows: DataFrame, radius: int, block: int | None = None) -> DataFrame:
    """The rows once for each table v, buckets in order; with block as (.., v, i, j, side).

    The rows of a bucket over ``block`` are dealt to blocks; block i (side 0) meets block j (side 1) in a group of its own,
    and itself in (i, i), so that no task has a whole large bucket.
    """
    bits = masks(radius)
    kept = F.col("fp").bitwiseAND(F.element_at(F.lit([_signed(m) for m in bits]), F.col("v") + 1))
    each, group = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(len(bits) - 1)))), []
    if block is not None:
        zero, group = F.lit(0), ["i", "j"]
        sizes = each.groupBy("v", kept.alias("key")).count().where(F.col("count") > block)
        large = stage(sizes.select("v", "key", F.ceil(F.col("count") / block).cast("int").alias("n")), "large") if rows.count() > block else None
        if large is None or large.isEmpty():
            each = each.withColumns({"i": zero, "j": zero, "side": zero})
        else:
            own = F.pmod(F.xxhash64("k"), F.col("n")).cast("int")
            blocks = each.withColumn("key", kept).join(large, ["v", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
            met = blocks.withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, F.col("n") - 1)))
            each = met.select(*each.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return each.repartition(partitions(rows.sparkSession), kept, "v", *group).sortWithinPartitions(kept, "v", *group)


def _groups(batches, names: tuple[str, ...], bits, held: int | None = None):
    """Whole groups, some at a time: (number of each row's group, columns) of rows in the order of ``_in_tables``.

    Of a group that goes on in the next batch and is over ``held``, earlier rows go out in parts of more than ``held`` rows.
    """
    import numpy as np

    left = None
    for batch in itertools.chain(batches, [None]):
        new = None if batch is None else [np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) if n == "sketch" else batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        rows = new if left is None else left if new is None else [np.concatenate(p) for p in zip(left, new)]
        if rows is None or not len(rows[0]):
            continue
        of = dict(zip(names, rows))
        parts = [of["fp"].view(np.uint64) & bits[of["v"]], *(of[n] for n in ("v", "i", "j") if n in of)]
        starts = np.concatenate([[True], np.logical_or.reduce([p[1:] != p[:-1] for p in parts])])
        end = len(starts) if new is None else int(np.flatnonzero(starts)[-1])
        if end:
            yield np.cumsum(starts[:end]), {n: c[:end] for n, c in of.items()}
        if new is not None and held is not None and len(starts) - end > 2 * held + 2:
            yield np.zeros(len(starts) - end - held - 1, np.int64), {n: c[end : -held - 1] for n, c in of.items()}
            end = len(starts) - held - 1
        left = [r[end:] for r in rows]


def _near(group, of, radius: int):
    """Pairs of positions (x, y) within a group and the radius, shingles' fingerprints not FAR apart; a distance at a time."""
    import numpy as np

    fp, sfp = of["fp"].view(np.uint64), of["sfp"].view(np.uint64)
    x, step = np.arange(len(group)), 0
    while len(x):
        step += 1
        x = x[: np.searchsorted(x, len(group) - step)]
        x = x[group[x] == group[x + step]]
        y = x + step
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= radius) & (np.bitwise_count(sfp[x] ^ sfp[y]) <= FAR)
        if near.any():
            yield x[near], y[near]


def _first_table(fp, other, v, bits):
    """Where v is the first table in which two fingerprints meet."""
    import numpy as np

    first, differ = np.ones(len(v), bool), fp ^ other
    for t in range(int(v.max(initial=0))):
        first &= (v <= t) | (differ & bits[t] != 0)
    return first


class _Best:
    """For each position the partner of the least measure, then of the smallest k."""

    def __init__(self, k):
        import numpy as np

        self.k, self.measure, self.at = k, np.full(len(k), np.inf), np.full(len(k), -1)

    def see(self, x, y, measure):
        for one, other in ((x, y), (y, x)):  # no position twice in either
            old = self.measure[one]
            better = (measure < old) | ((measure == old) & (self.k[other] < self.k[self.at[one]]))
            self.measure[one[better]], self.at[one[better]] = measure[better], other[better]

    def found(self, of, bits):
        """Positions that have a partner, and the partners; each pair in its first table only, so the best of all tables is one of them."""
        import numpy as np

        x = np.flatnonzero(self.at >= 0)
        fp = of["fp"].view(np.uint64)
        x = x[_first_table(fp[x], fp[self.at[x]], of["v"][x], bits)]
        return x, self.at[x]


def _mates(radius: int, block: int):
    """k of rows that have another near; all rows of buckets over ``block``."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.array(masks(radius), np.uint64)
        for group, rows in _groups(batches, ("v", "k", "fp", "sfp"), bits, block):
            large = np.bincount(group)[group] > block
            best, fp, at = _Best(rows["k"]), rows["fp"].view(np.uint64), np.flatnonzero(~large)
            for x, y in _near(group[at], {n: c[at] for n, c in rows.items()}, radius):
                best.see(at[x], at[y], np.bitwise_count(fp[at[x]] ^ fp[at[y]]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["k"][np.concatenate([np.flatnonzero(large), best.found(rows, bits)[0]])])], ["k"])

    return of


def _candidates(radius: int, similarity: float, best: bool):
    """(a, b, apart): pairs of rows of other labels that may be near copies; for each row a its most similar one, or all with a > b."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.array(masks(radius), np.uint64)
        for group, rows in _groups(batches, ("v", "i", "j", "side", "k", "fp", "sfp", "label", "size", "sketch"), bits):
            k, label, size, sketch, fp, across, side = (rows[n] for n in ("k", "label", "size", "sketch", "fp", "i", "side"))
            across, fp, found, nearest = across != rows["j"], fp.view(np.uint64), [], _Best(k)
            for x, y in _near(group, rows, radius):
                other = (label[x] != label[y]) & (~across[x] | (side[x] != side[y]))
                x, y = x[other], y[other]
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
                near = apart <= most_apart(size[x] + size[y], similarity)
                x, y, apart = x[near], y[near], apart[near]
                if best:
                    nearest.see(x, y, (apart + 1) / np.maximum(size[x] + size[y], 1))
                else:
                    once = _first_table(fp[x], fp[y], rows["v"][x], bits)
                    found.append((np.maximum(k[x], k[y])[once], np.minimum(k[x], k[y])[once], apart[once] * 1.0))
            if best:
                x, y = nearest.found(rows, bits)
                found = [(k[x], k[y], nearest.measure[x])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[n] for f in found] or [np.zeros(0)]).astype(t)) for n, t in enumerate((np.int64, np.int64, np.float64))], ["a", "b", "apart"])

    return of


def near_copies(docs_keyed: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(node, root): for texts with a near copy, the smallest k of their component."""
    spark = docs_keyed.sparkSession
    fps = stage(word_and_shingle_fingerprints(docs_keyed, width), "words")
    some = stage(_in_tables(fps, radius).select("v", "k", "fp", "sfp").mapInArrow(_mates(radius, block), "k long").distinct(), "mates")
    sets = stage(sketched_sets(docs_keyed.select("k", "text").join(some, "k", "left_semi"), width), "shingles")
    rows = stage(fps.join(sets.select("k", "size", "sketch"), "k"), "sketched")
    roots = spark.createDataFrame([], "node long, root long")
    tested = spark.createDataFrame([], "a long, b long")
    for reach, best in ((min(radius, CLOSE), True), (radius, True), (radius, False)):
        named = stage(rows.join(roots, F.col("k") == F.col("node"), "left").select("k", "fp", "sfp", "size", "sketch", F.coalesce("root", "k").alias("label")), "named")
        found = stage(_in_tables(named, reach, block).mapInArrow(_candidates(reach, similarity, best), "a long, b long, apart double"), "met")
        pairs = found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")) if best else found
        pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        links = _verified(pairs, sets, similarity)
        if not links.isEmpty():
            roots = stage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "near-roots")
        if best and reach == radius:  # only these have candidates in other components
            rows = rows.join(stage(found.select(F.col("a").alias("k")).distinct(), "left"), "k", "left_semi")
    return roots


def dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all their columns; of each component of near copies the row with the smallest doc_id stays."""
    rows = keyed(docs, row=True)
    gone = near_copies(rows, width, similarity, radius).where("node <> root").select(F.col("node").alias("k"))
    return rows.select("k", "_row").join(gone, "k", "left_anti").select("_row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
