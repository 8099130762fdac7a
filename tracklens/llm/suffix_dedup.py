"""Suffix-array dedup: remove every byte that a long string covers which also starts earlier.

Whole texts as UTF-8; a string of ``WIDTH`` (100) bytes is repeated if it also starts earlier: in a document
with a smaller key, or before in the same document. All of its bytes go; strings are judged on the input.

The strings that start in a text are the prefixes of its suffixes, so equal strings are neighbours in
sorted suffixes. Sorting the suffixes of all texts at every byte isn't needed for that: each string has an
anchor, the GRAM (32) bytes in it with the least hash, and equal strings have equal anchors at the same
place. So only suffixes that start at anchors (one in about 32 bytes) are gathered and sorted:

1. Every task lists its texts' anchors: gram hash, hash of all that its strings cover (the context), the
   range of strings it stands for. Equal contexts within a batch leave one row; the others are repeated.
2. Owners of gram hashes compare contexts: of equal ones the earliest stays (told by 64 bits of the gram's
   hash and 128 of the context's, not by bytes: those would be fetched for every copy of every text). Where a
   gram has several contexts, each asks for its bytes. Grams seen once are dropped here, which is nearly all
   of the text.
3. Texts and requests meet by document; the contexts' bytes go to the owners of the grams.
4. There the suffixes are put in order by deep-shallow sorting: multikey quicksort, a word at a time and only
   within ties, to a shallow depth; then blind tries order the groups with longer common prefixes. With
   the common prefixes of neighbours, and the bytes to the left of the anchors, each string finds the
   earliest string equal to it.
5. Texts and repeated ranges meet by document.

Rows travel as packed arrays, a few for each task and owner; texts as compressed Arrow batches. A gram with
very many contexts (HOT) is split by the bytes that its strings of neighbouring offsets (CLASS) have in common,
82 at least, so a common phrase shorter than that doesn't gather in one task. An
owner that gathers too many rows (HELD) deals them to files by gram and settles one file after the other, so
whether a gram has several contexts, or is hot, is always told from all of its contexts.

Defined results: a null text counts as empty; texts shorter than WIDTH bytes lose nothing; keys are unique
(repeated doc_ids and nulls are put in the order of ``keyed``, so of repeated rows the first stays); other
columns pass through ``dedup`` unchanged; an empty table gives an empty result. Removal can cut a
character in two; ``dedup`` drops the broken bytes of such a character from the text it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import keyed, partitions, stage, table

WIDTH, GRAM = 100, 32
#: Strings with a gram at one of SPAN places.
SPAN = WIDTH - GRAM + 1
LEFT = WIDTH - GRAM
#: Contexts of a gram from which it is split by neighbouring bytes; rows an owner holds before it deals them to FILES.
HOT, HELD, FILES = 1000, 4_000_000, 64
#: Offsets whose strings of a hot gram go to one owner.
CLASS = 18
#: Contexts that a task gathers before it deals them out.
GATHERED = 50_000
#: Bytes hashed at once.
CHUNK = 1 << 20
#: Words of 8 bytes that the shallow sort looks at.
SHALLOW = 6
ROUTED = "target int, kind int, data binary"
INDEX, REQUEST, RANGE, TEXTS = 0, 1, 2, 3


def _types():
    import numpy as np

    anchor = np.dtype([("h", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("k", "<i8"), ("a", "<u4"), ("hi", "u1"), ("lo", "u1")])
    request = np.dtype([("k", "<i8"), ("h", "<u8"), ("a", "<u4"), ("hi", "u1"), ("lo", "u1"), ("hot", "u1")])
    context = np.dtype([("h", "<u8"), ("k", "<i8"), ("a", "<u4"), ("hi", "u1"), ("lo", "u1"), ("left", "u1", LEFT), ("right", "u1", WIDTH)])
    span = np.dtype([("k", "<i8"), ("from", "<u4"), ("to", "<u4")])
    return anchor, request, context, span


def _mix(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _byte_values(seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def anchors(buf, ends, keys, offsets):
    """Anchor rows of texts laid end to end in buf. ``offsets``: where in its document each text starts."""
    import numpy as np

    kind = _types()[0]
    n = len(buf)
    if n < WIDTH:
        return np.zeros(0, kind)
    with np.errstate(over="ignore"):
        h, step, base = _byte_values(1)[buf], 1, np.array(0x9E3779B97F4A7C15, np.uint64)
        while step < GRAM:  # the hash of 2 x step bytes from two of step bytes
            h = h[:-step] * base + h[step:]
            step, base = 2 * step, base * base
        h = _mix(h)
        # least hash of the grams in each string; the place in the low bits makes it the leftmost one
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: len(least) - (SPAN - step)], least[SPAN - step :])
        starts = ends - np.diff(ends, prepend=0)
        inside = np.zeros(n + 1, np.int32)
        able = ends - starts >= WIDTH
        inside[starts[able]] += 1
        inside[ends[able] - WIDTH + 1] -= 1
        p = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
        at = (least[p] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        low, high, at = p[first], p[np.append(first[1:], len(p)) - 1] if len(p) else p[first], at[first]
        # two hashes of buf[low : high + WIDTH] from sums of prefixes
        contexts = []
        for seed, odd in ((2, 0xD6E8FEB86659FD93), (6, 0xA24BAED4963EE407)):
            powers = np.cumprod(np.full(n, odd, np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values(seed)[buf] * powers)])
            inverse = np.cumprod(np.full(n, pow(odd, -1, 1 << 64), np.uint64))
            contexts.append(_mix((sums[high + WIDTH] - sums[low]) * inverse[low]))
    text = np.searchsorted(ends, at, side="right")
    out = np.empty(len(at), kind)
    out["h"], (out["c"], out["c2"]), out["k"], out["a"] = h[at], contexts, keys[text], at - starts[text] + offsets[text]
    out["hi"], out["lo"] = at - low, at - high
    return out


def _pieces(texts, keys):
    """Texts in groups of about CHUNK bytes; very long ones in pieces that overlap by a string."""
    import numpy as np

    group, size = [], 0

    def done():
        raw = [x for x, _, _ in group]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]), np.array([k for _, k, _ in group], np.int64), np.array([o for _, _, o in group], np.int64)

    for text, k in zip(texts, keys, strict=True):
        for at in range(0, max(1, len(text) - WIDTH + 1), CHUNK):
            piece = text[at : at + CHUNK + WIDTH - 1]
            group.append((piece, k, at))
            size += len(piece)
            if size >= CHUNK:
                yield done()
                group, size = [], 0
    if group:
        yield done()


def resolve(rows):
    """Of anchors with equal contexts the earliest stays. Gives (those that stay, ranges of the others).

    Equal means: equal in the 64-bit hash of the gram and in two of 64 bits of the whole context.
    """
    import numpy as np

    if not len(rows):
        return rows, np.zeros(0, _types()[3])
    rows = rows[np.lexsort((rows["a"], rows["k"], rows["lo"], rows["hi"], rows["c"], rows["h"]))]
    first = np.ones(len(rows), bool)
    # not sorted by c2: if c alone were equal, both contexts would stay and be told apart by their bytes
    first[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1]) | (rows["c2"][1:] != rows["c2"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1])
    return rows[first], spans_of(rows[~first])


def spans_of(rows):
    """The ranges that all strings of the given anchors cover."""
    import numpy as np

    out = np.empty(len(rows), _types()[3])
    out["k"], out["from"], out["to"] = rows["k"], rows["a"] - rows["hi"], rows["a"] - rows["lo"] + WIDTH
    return out


def _owner(values, n: int):
    import numpy as np

    return (_mix(np.asarray(values).astype(np.uint64) + np.uint64(77)) >> np.uint64(20)) % np.uint64(n)


def _parts(targets):
    """(target, positions) for each target."""
    import numpy as np

    order = np.argsort(targets, kind="stable")
    cuts = np.flatnonzero(np.diff(targets[order])) + 1
    return [(int(targets[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def _deal(rows, targets, kind: int):
    """(target, kind, bytes) for each target."""
    return [(target, kind, rows[part].tobytes()) for target, part in _parts(targets)]


def _batch(rows):
    import pyarrow as pa

    t, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["target", "kind", "data"])


def _by_target(batches, process):
    """Calls process(target, rows of (kind, data)) as a generator for each run of a target; rows are read lazily."""
    from itertools import groupby

    def flat():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("target", "kind", "data")), strict=True)

    for target, rows in groupby(flat(), key=lambda r: r[0]):
        yield from process(target, ((kind, data) for _, kind, data in rows))


class Files:
    """Rows dealt to unnamed local files by a hash of a value; each file can be read once."""

    def __init__(self, kind, n: int):
        import tempfile

        self.kind, self.rows, self.files = kind, [0] * n, [tempfile.TemporaryFile() for _ in range(n)]

    def put(self, rows, values) -> None:
        import numpy as np

        # mixed before, as the values may be those that dealt the rows to this owner
        for i, part in _parts(_owner(_mix(np.asarray(values) ^ np.uint64(0xA0761D6478BD642F)), len(self.files))):
            self.files[i].write(rows[part].tobytes())
            self.rows[i] += len(part)

    def pieces(self, i: int):
        import numpy as np

        self.files[i].seek(0)
        while data := self.files[i].read(HELD * self.kind.itemsize):
            yield np.frombuffer(data, self.kind)
        self.files[i].close()

    def all(self, i: int):
        import numpy as np

        return np.concatenate([np.zeros(0, self.kind), *self.pieces(i)])


def _list_anchors(owners: int):
    """Step 1."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.binary()))
            found = [anchors(*piece) for piece in _pieces(texts, batch.column("k").to_pylist())]
            kept, ranges = resolve(np.concatenate(found) if found else np.zeros(0, _types()[0]))
            kept = kept[np.lexsort((kept["a"], kept["k"]))]
            yield _batch(_deal(kept, _owner(kept["h"], owners), INDEX) + _deal(ranges, _owner(ranges["k"], owners), RANGE))

    return of


def _compare_contexts(owners: int):
    """Step 2. Ranges pass through; both they and requests are dealt by document."""
    import itertools

    def ask(rows, several):
        import numpy as np

        out = np.empty(len(rows), _types()[1])
        for x in ("k", "h", "a", "hi", "lo"):
            out[x] = rows[x]
        out["hot"] = several >= HOT
        return _deal(out, _owner(out["k"], owners), REQUEST)

    def passed_on(ranges):
        return _deal(ranges, _owner(ranges["k"], owners), RANGE)

    def settle(rows):
        import numpy as np

        stay, ranges = resolve(rows)
        _, at, times = np.unique(stay["h"], return_inverse=True, return_counts=True)
        several = times[at] if len(stay) else np.zeros(0, np.int64)
        return passed_on(ranges) + ask(stay[several > 1], several[several > 1])

    def settle_many(files, i):
        """A file that is too long is dealt again by context; its grams' contexts are counted over all parts."""
        import numpy as np

        kind = _types()[0]
        parts, left = Files(kind, -(-files.rows[i] // HELD)), Files(kind, 1)
        for piece in files.pieces(i):
            parts.put(piece, piece["c"])
        grams, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for j in range(len(parts.rows)):
            stay, ranges = resolve(parts.all(j))
            yield _batch(passed_on(ranges))
            left.put(stay, stay["h"])
            new, n = np.unique(stay["h"], return_counts=True)
            grams, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n]), len(grams)).astype(np.int64)
        for stay in left.pieces(0):
            several = times[np.searchsorted(grams, stay["h"])]
            yield _batch(ask(stay[several > 1], several[several > 1]))

    def process(_, rows):
        import numpy as np

        kind = _types()[0]
        held, size, files = [np.zeros(0, kind)], 0, None
        for what, data in rows:
            if what == RANGE:
                span = np.frombuffer(data, _types()[3])
                yield _batch([(int(_owner(span["k"][:1], owners)[0]), RANGE, data)])
                continue
            held.append(np.frombuffer(data, kind))
            size += len(held[-1])
            if size > HELD:
                stay, ranges = resolve(np.concatenate(held))
                yield _batch(passed_on(ranges))
                held, size = [stay], len(stay)
                if size > HELD // 2:
                    files = files or Files(kind, FILES)
                    files.put(stay, stay["h"])
                    held, size = [stay[:0]], 0
        if files is None:
            yield _batch(settle(np.concatenate(held)))
            return
        rest = np.concatenate(held)
        files.put(rest, rest["h"])
        for i in range(FILES):
            if files.rows[i] > HELD:
                yield from settle_many(files, i)
            elif files.rows[i]:
                yield _batch(settle(files.all(i)))

    return lambda batches: itertools.chain(_by_target(batches, process), [_batch([])])


def _pack_texts(owners: int):
    """Rows of documents as compressed Arrow batches for the owners of documents."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for target, part in _parts(_owner(batch.column("k").to_numpy(zero_copy_only=False), owners)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(batch.take(pa.array(part)))
                out.append((target, TEXTS, sink.getvalue().to_pybytes()))
                if len(out) >= 64:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return of


def _unpack(data):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


def _fetch_contexts(owners: int):
    """Step 3. Contexts are gathered over many texts, so that an owner gets few and large arrays."""

    def dealt(out):
        import numpy as np

        every = np.concatenate(out)
        return _batch(_deal(every, _owner(every["h"], owners), INDEX))

    def process(_, rows):
        import numpy as np

        _, kind, context, _ = _types()
        asked, out, size = [], [], 0
        for what, data in rows:
            if what == REQUEST:
                asked.append(np.frombuffer(data, kind))
                continue
            if isinstance(asked, list):  # texts follow all requests
                asked = np.concatenate(asked) if asked else np.zeros(0, kind)
                asked = asked[np.argsort(asked["k"], kind="stable")]
            docs = _unpack(data)
            for k, text in zip(docs["k"].to_pylist(), docs["text"], strict=True):
                a, b = np.searchsorted(asked["k"], k), np.searchsorted(asked["k"], k, side="right")
                if a < b:
                    raw = np.frombuffer(text.as_py().encode(), np.uint8)
                    out.append(_contexts(raw, asked[a:b], context))
                    size += len(out[-1])
            if size >= GATHERED:
                yield dealt(out)
                out, size = [], 0
        if out:
            yield dealt(out)

    return lambda batches: _by_target(batches, process)


def _contexts(raw, rows, kind):
    """The bytes about each anchor, zeros outside its context; anchors of hot grams for each class of offsets apart."""
    import numpy as np

    out = np.zeros(len(rows), kind)
    for x in ("h", "k", "a", "hi", "lo"):
        out[x] = rows[x]
    padded = np.concatenate([np.zeros(LEFT, np.uint8), raw, np.zeros(WIDTH, np.uint8)])
    at = rows["a"].astype(np.int64)[:, None] + LEFT
    left, right = np.arange(-LEFT, 0)[None], np.arange(WIDTH)[None]
    out["left"] = np.where(-left <= rows["hi"][:, None], padded[at + left], 0)
    out["right"] = np.where(right < WIDTH - rows["lo"][:, None].astype(int), padded[at + right], 0)
    hot = rows["hot"] > 0
    if not hot.any():
        return out
    every, parts = out[hot], [out[~hot]]
    for first in range(0, SPAN, CLASS):
        last = min(first + CLASS, SPAN) - 1
        part = every[(every["lo"] <= last) & (every["hi"] >= first)]
        part["lo"], part["hi"] = np.maximum(part["lo"], first), np.minimum(part["hi"], last)
        # what all strings that start first to last bytes before the gram have in common
        shared = np.concatenate([part["left"][:, LEFT - first :], part["right"][:, : WIDTH - last]], axis=1)
        with np.errstate(over="ignore"):
            sums = (_byte_values(3)[shared] * np.cumprod(np.full(shared.shape[1], 0x9E3779B97F4A7C15, np.uint64))).sum(1, dtype=np.uint64)
            part["h"] = _mix(part["h"] * np.uint64(2 * first + 7) + _mix(sums))
        parts.append(part)
    return np.concatenate(parts)


class BlindTrie:
    """Orders strings with long common prefixes: inner nodes keep only the depth at which strings part.

    A search follows a string's bytes at those depths without looking at the ones between, so it reads the
    string once, against the one leaf it ends at.
    """

    def __init__(self):
        self.root = None

    def add(self, name, text: bytes) -> None:
        if self.root is None:
            self.root = (text, [name])
            return
        node = self.root
        while isinstance(node, list):
            depth, children = node
            node = children.get(text[depth]) or next(iter(children.values()))
        common = common_prefix(text, node[0])
        if common == len(text):
            node[1].append(name)
            return
        leaf, above, node = (text, [name]), None, self.root
        while isinstance(node, list) and node[0] < common:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == common:
            node[1][text[common]] = leaf
            return
        other = node
        while isinstance(other, list):  # any leaf below tells the byte at which the old branch goes on
            other = next(iter(other[1].values()))
        fork = [common, {other[0][common]: node, text[common]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def ordered(self) -> list:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node is not None:
                out += node[1]
        return out


def common_prefix(x: bytes, y: bytes) -> int:
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def deep_shallow_order(groups, strings):
    """Order of the rows of a byte matrix within groups; groups come in the order of their numbers."""
    import numpy as np

    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8")
    order = np.argsort(groups, kind="stable")
    tie = np.cumsum(np.diff(groups[order], prepend=groups[order[:1]]) != 0) if n else np.zeros(0, np.int64)
    for depth in range(min(SHALLOW, words.shape[1])):  # multikey quicksort: only ties are looked at again
        sizes = np.bincount(tie, minlength=1)
        open_ = np.flatnonzero(sizes[tie] > 1)
        if not len(open_):
            return order
        word = words[order[open_], depth].astype(np.uint64)
        again = np.lexsort((word, tie[open_]))
        order[open_] = order[open_][again]
        word = word[again]
        new = np.zeros(n, bool)
        new[1:] = tie[1:] != tie[:-1]
        parts = np.zeros(len(open_), bool)
        parts[1:] = word[1:] != word[:-1]
        new[open_] |= parts
        new[:1] = False
        tie = np.cumsum(new)
    starts = np.flatnonzero(np.diff(tie, prepend=-1))
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
        if b - a > 1:
            trie = BlindTrie()
            for i in order[a:b].tolist():
                trie.add(i, strings[i].tobytes())
            order[a:b] = trie.ordered()
    return order


def repeated_strings(rows):
    """Ranges of the strings of ``context`` rows that equal an earlier string of the rows."""
    import numpy as np

    span = _types()[3]
    if not len(rows):
        return np.zeros(0, span)
    groups = np.unique(rows["h"], return_inverse=True)[1]
    order = deep_shallow_order(groups, rows["right"])
    rows, groups = rows[order], groups[order]
    n = len(rows)
    common = np.zeros(n, np.int64)  # bytes in common with the suffix before
    for at in range(1, n, 1 << 16):
        end = min(n, at + (1 << 16))
        differ = rows["right"][at:end] != rows["right"][at - 1 : end - 1]
        common[at:end] = np.where(differ.any(1), differ.argmax(1), WIDTH)
    common[np.flatnonzero(np.diff(groups, prepend=-1))] = -1
    age = np.empty(n, np.int64)
    age[np.lexsort((rows["a"], rows["k"]))] = np.arange(n)
    hit = np.zeros((n, LEFT + 2), bool)
    value, left_hash = _byte_values(5), np.zeros(n, np.uint64)
    for offset in range(LEFT + 1):  # strings that start this far before the anchor
        if offset:
            with np.errstate(over="ignore"):
                left_hash = _mix(left_hash * np.uint64(0x9E3779B97F4A7C15) + value[rows["left"][:, LEFT - offset]])
        alike = np.cumsum(common < WIDTH - offset)
        own = np.flatnonzero((rows["lo"] <= offset) & (offset <= rows["hi"]))
        own = own[np.lexsort((age[own], left_hash[own], alike[own]))]
        same = np.zeros(len(own), bool)
        same[1:] = (alike[own][1:] == alike[own][:-1]) & (left_hash[own][1:] == left_hash[own][:-1])
        later = own[same]
        before = own[np.flatnonzero(same) - 1]
        exact = (rows["left"][later][:, LEFT - offset :] == rows["left"][before][:, LEFT - offset :]).all(1)
        if not exact.all():
            raise RuntimeError("two different strings with equal 64-bit hashes")
        hit[later, offset + 1] = True
    step = np.diff(hit.astype(np.int8), axis=1, append=0)
    i, first = np.nonzero(step[:, :] == 1)
    _, last = np.nonzero(step[:, :] == -1)
    out = np.empty(len(i), span)
    a = rows["a"][i].astype(np.int64)
    out["k"], out["from"], out["to"] = rows["k"][i], a - (last - 1), a - first + WIDTH
    return out


def _find_repeats(owners: int):
    """Step 4."""

    def process(_, rows):
        import numpy as np

        context = _types()[2]
        ranges = repeated_strings(np.concatenate([np.frombuffer(data, context) for _, data in rows]))
        yield _batch(_deal(ranges, _owner(ranges["k"], owners), RANGE))

    return lambda batches: _by_target(batches, process)


def _runs(spans):
    """Sorted, disjoint runs of covered bytes."""
    import numpy as np

    spans = spans[np.argsort(spans["from"], kind="stable")]
    reach = np.maximum.accumulate(spans["to"])
    new = np.ones(len(spans), bool)
    new[1:] = spans["from"][1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return list(zip(spans["from"][starts].tolist(), reach[np.append(starts[1:], len(spans)) - 1].tolist(), strict=True))


def _cut(owners: int, finish):
    """Step 5: finish(Arrow table of documents, list of (raw, runs)) gives the batch that goes out."""

    def process(_, rows):
        import numpy as np

        span = _types()[3]
        known = []
        for what, data in rows:
            if what == RANGE:
                known.append(np.frombuffer(data, span))
                continue
            if isinstance(known, list):
                known = np.concatenate(known) if known else np.zeros(0, span)
                known = known[np.argsort(known["k"], kind="stable")]
            docs = _unpack(data)
            cut = []
            for k, text in zip(docs["k"].to_pylist(), docs["text"], strict=True):
                a, b = np.searchsorted(known["k"], k), np.searchsorted(known["k"], k, side="right")
                cut.append(((text.as_py() or "").encode(), _runs(known[a:b]) if a < b else []))
            yield from finish(docs, cut)

    return lambda batches: _by_target(batches, process)


def _left_over(raw: bytes, runs) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _digests(docs, cut):
    import hashlib

    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([
        docs["doc_id"].combine_chunks(),
        pa.array([len(raw) for raw, _ in cut], pa.int64()),
        pa.array([sum(b - a for a, b in runs) for _, runs in cut], pa.int64()),
        pa.array([len(runs) for _, runs in cut], pa.int64()),
        pa.array([hashlib.sha256(_left_over(raw, runs)).hexdigest() for raw, runs in cut], pa.string()),
    ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs, cut):
    import pyarrow as pa

    row = docs["_row"].combine_chunks()
    row = row if isinstance(row, pa.StructArray) else pa.concat_arrays(row.chunks)
    names = [f.name for f in row.type]
    new = pa.array([None if not raw and old is None else _left_over(raw, runs).decode(errors="ignore") if runs else raw.decode() for (raw, runs), old in zip(cut, docs["text"].to_pylist(), strict=True)], pa.string())
    arrays = [new if x == "text" else y for x, y in zip(names, row.flatten(), strict=True)]
    yield from pa.Table.from_arrays(arrays, names).to_batches()


def _dealt(df: DataFrame, owners: int) -> DataFrame:
    return df.repartitionById(owners, F.col("target")).sortWithinPartitions("target", "kind")


def _removed(docs_keyed: DataFrame, payload: DataFrame, finish, schema) -> DataFrame:
    owners = partitions(docs_keyed.sparkSession)
    listed = docs_keyed.select("k", "text").mapInArrow(_list_anchors(owners), ROUTED)
    compared = stage(_dealt(listed, owners).mapInArrow(_compare_contexts(owners), ROUTED), "anchors")
    texts = docs_keyed.select("k", "text").mapInArrow(_pack_texts(owners), ROUTED)
    asked = _dealt(compared.where(F.col("kind") == REQUEST).union(texts), owners)
    contexts = asked.mapInArrow(_fetch_contexts(owners), ROUTED)
    repeats = stage(_dealt(contexts, owners).mapInArrow(_find_repeats(owners), ROUTED), "repeats")
    ranges = compared.where(F.col("kind") == RANGE).union(repeats)
    return _dealt(ranges.union(payload.mapInArrow(_pack_texts(owners), ROUTED)), owners).mapInArrow(_cut(owners, finish), schema)


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""
    rows = keyed(docs)
    return _removed(rows, rows.select("k", "doc_id", "text"), _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the repeated bytes gone from text."""
    rows = keyed(docs, row=True)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema])
    return _removed(rows, rows.select("k", "text", "_row"), _texts, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE_SQL = {
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d),
s AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM w),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p - q <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
kept AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
text_ AS (SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM kept k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(sum(s.b - s.a), 0)::BIGINT AS n_removed, count(s.a)::BIGINT AS n_spans, any_value(sha256(unhex(t.h))) AS kept_sha256
FROM d JOIN text_ t ON t.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.h"""
}
