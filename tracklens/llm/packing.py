"""Best-fit packing: bin completion by branch and bound over the lengths of documents.

A document is its token ids (``tokens.encode``) and an end token. Longer ones than a sequence are cut into
full pieces behind a first, shorter one; full pieces are sequences of their own. What is left to pack is
known by how many pieces have each length: at most ``capacity`` numbers, whatever the corpus. The
best-fit-decreasing packing is the first incumbent. To beat it by a bin, all bins together may waste only so
much; that is the bound by which branches are cut. Bins are completed around the largest piece left, by
fillings of the space beside it: a filling is cut while it grows if the pieces still to come can't bring its
waste under the bound, and dropped if another dominates it, that is if pieces not in it could take the place
of one or two of its own and waste less. A filling is used as often as its pieces last, or once; the search
is depth first, least waste first: with the best filling of each bin only, then with a few, then with all.
It ends at the lower bound or when nothing is left to try (``optimal`` says so), or after ``nodes`` steps:
packing is NP-hard, so beyond that many the best incumbent is the result. Every piece is packed in any case.
Pieces are numbered within their length, and the number says which bin and place is theirs.

Defined results: a null text counts as empty and is packed as its end token; repeated rows are packed one by
one; texts are read whole, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import keyed, number_within, partitions, stage, table
from tracklens.llm.tokens import encode

CAPACITY = 2048
END = 0
PIECE = "k long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs_keyed: DataFrame, capacity: int = CAPACITY, root: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds the token ids themselves."""

    def of(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows, ids = [], []
            for k, i, text in zip(batch.column("k").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                tokens = np.append(encode(text.as_py() or "", root), np.uint32(END)).astype("<u4")
                for n, (start, length) in enumerate(cut(len(tokens), capacity)):
                    own = tokens[start : start + length]
                    rows.append((k, i, n, start, length, zlib.crc32(own.tobytes())))
                    ids.append(own.astype(np.int32))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return docs_keyed.select("k", "doc_id", "text").mapInArrow(of, PIECE + ", ids array<int>" * with_ids)


class Packer:
    """Bins for ``counts``: {length: pieces}. ``bins``: [(times, lengths of a bin, largest first)]."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 1_500_000):
        self.capacity, self.left = capacity, nodes
        self.tokens = sum(x * n for x, n in counts.items())
        self.bound = lower_bound(counts, capacity)
        self.bins = best_fit_decreasing(counts, capacity)
        self.optimal = self.size() <= self.bound
        for width, share in ((1, 3), (4, 2), (None, 1)):
            if not self.optimal:
                self._complete(dict(counts), width, self.left - self.left // share)

    def size(self) -> int:
        return sum(times for times, _ in self.bins)

    def _complete(self, counts: dict[int, int], width: int | None, until: int) -> None:
        """Depth first; a frame holds the bins so far, their pieces to give back, and the fillings still to try."""
        best, left, bins, used, filled = self.size(), counts, [], 0, 0
        slack = lambda: (best - 1) * self.capacity - self.tokens - (used * self.capacity - filled)
        frames = [self._fillings(left, slack(), width)]
        while frames:
            if self.left <= until:
                return
            if not frames[-1]:
                frames.pop()
                if bins:
                    times, filling = bins.pop()
                    used, filled = used - times, filled - times * sum(filling)
                    for x in filling:
                        left[x] = left.get(x, 0) + times
                continue
            times, filling = frames[-1].pop()
            if used + times >= best or times * (self.capacity - sum(filling)) > slack():
                continue
            for x in filling:
                left[x] -= times
                if not left[x]:
                    del left[x]
            bins.append((times, filling))
            used, filled = used + times, filled + times * sum(filling)
            if not left:
                best, self.bins = used, list(bins)
                self.optimal = best <= self.bound
                if self.optimal or width == 1:
                    return
            open_ = left and used + least_bins(left, self.capacity) < best
            frames.append(self._fillings(left, slack(), width) if open_ else [])
        self.optimal = self.optimal or width is None

    def _fillings(self, left: dict[int, int], most_waste: int, width: int | None) -> list[tuple[int, list[int]]]:
        """(times, filling) around the largest piece: at most ``width`` undominated ones, the one to try first last."""
        largest = max(left)
        room = self.capacity - largest
        sizes = sorted((x for x in left if x <= room), reverse=True)
        have = {x: left[x] - (x == largest) for x in sizes}
        sizes = [x for x in sizes if have[x]]
        if room in have and have[room]:
            found = [(0, [room])]  # an exact fit by one piece dominates all other fillings
        else:
            found = self._undominated(sizes, have, room, most_waste, width)
        out = []
        for _, f in reversed(found):
            filling = [largest, *f]
            times = min(left[x] // filling.count(x) for x in set(filling))
            out += [(1, filling)] * (width is None and times > 1) + [(times, filling)]
        return out

    def _undominated(self, sizes, have, room: int, most_waste: int, width: int | None):
        """[(waste, pieces)], least waste first; pieces fall in size."""
        from bisect import bisect_left, insort

        rising = sizes[::-1]
        rest = [0] * (len(sizes) + 1)  # all that the pieces from a place on can fill
        for i in range(len(sizes) - 1, -1, -1):
            rest[i] = min(self.capacity, rest[i + 1] + sizes[i] * min(have[sizes[i]], room // sizes[i]))
        found: list[tuple[int, list[int]]] = []
        chosen: list[int] = []
        spare = dict(have)

        def dominated(waste: int) -> bool:
            """Whether a spare piece could replace one or two of the chosen and waste less, or as little with fewer pieces."""
            parts = {(x, False) for x in chosen} | {(x + y, True) for i, x in enumerate(chosen) for y in chosen[i + 1 :]}
            for size, two in parts:
                i = bisect_left(rising, size + (not two))
                while i < len(rising) and rising[i] <= size + waste:
                    if spare[rising[i]]:
                        return True
                    i += 1
            return False

        at = [0]  # for each chosen piece, and then the next one, the place from which to choose
        while at:
            self.left -= 1
            limit = most_waste if width is None or len(found) < width else min(most_waste, found[-1][0] - 1)
            if limit < 0 or self.left <= 0 and found:
                break
            i = at[-1]
            while i < len(sizes) and (sizes[i] > room or not spare[sizes[i]]):
                i += 1
            if i < len(sizes) and room - rest[i] <= limit:
                at[-1] = i + 1  # after this branch, go on with smaller pieces
                chosen.append(sizes[i])
                spare[sizes[i]] -= 1
                room -= sizes[i]
                at.append(i)
                continue
            if room <= limit and not any(spare[x] for x in rising[: bisect_left(rising, room + 1)]) and not dominated(room):
                insort(found, (room, list(chosen)))
                del found[width if width is not None else len(found) :]
            at.pop()
            if chosen:
                room += chosen[-1]
                spare[chosen.pop()] += 1
        return found


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A quick lower bound: all tokens, or the pieces over half a bin."""
    return max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Pieces over half a bin need a bin each, and the others at least what they fill beyond the space beside those."""
    big = sorted((x for x in counts if 2 * x > capacity), reverse=True)
    best = least_bins(counts, capacity)
    for limit in {capacity - x for x in big} | {1}:  # pieces over capacity - limit take nothing of limit or more
        alone = sum(counts[x] for x in big if x > capacity - limit)
        shared = [x for x in big if x <= capacity - limit]
        room = sum((capacity - x) * counts[x] for x in shared)
        small = sum(x * n for x, n in counts.items() if limit <= x and 2 * x <= capacity)
        best = max(best, alone + sum(counts[x] for x in shared) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Pieces from large to small, each into the fullest bins that take it; alike bins are kept as one entry."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> contents -> bins
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                each = min(capacity // x, n)
                times = n // each
                place, contents = capacity - each * x, (x,) * each
            else:
                old, bins = next(iter(rooms[room].items()))
                each = min(room // x, n)
                times = min(bins, n // each)
                rooms[room][old] -= times
                if not rooms[room][old]:
                    del rooms[room][old]
                if not rooms[room]:
                    del rooms[room]
                place, contents = room - each * x, (*old, *[x] * each)
            rooms.setdefault(place, {})
            rooms[place][contents] = rooms[place].get(contents, 0) + times
            n -= each * times
    return [(times, list(contents)) for bins in rooms.values() for contents, times in bins.items()]


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple]:
    """length -> arrays (first number, sequence of that number, offset); a bin entry gives consecutive sequences."""
    import numpy as np

    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for times, lengths in bins:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(v, np.int64).T) for x, v in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, root: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs."""
    spark = docs.sparkSession
    cuts = stage(pieces(keyed(docs), capacity, root, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    packer = Packer(counts, capacity)
    table_of = places(packer.bins + ([(full, [capacity])] if full else []))
    shared = spark.sparkContext.broadcast(table_of)  # bounded: entries end a length, lengths are at most capacity

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, start, at = shared.value[int(x)]
                entry = np.searchsorted(first, number[own], side="right") - 1
                sequence[own], offset[own] = start[entry] + number[own] - first[entry], at[entry]
            keep = [n for n in batch.schema.names if n not in ("k", "number")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    numbered = number_within(cuts, ["length"], ["k", "piece"], "number", min(1024, max(64, partitions(spark))))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    columns = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
    return numbered.select(*columns, "number").mapInArrow(place, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
