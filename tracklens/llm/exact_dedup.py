"""Exact dedup over an extendible-hash index on shared files.

Texts are equal when they are identical after every run of ASCII white space became one space. The index
has one entry per hash of a normalised text:

1. ``entries``: (k, doc_id, hash, sha256) of every document, a narrow table in the shared folder.
2. ``Directory``: entries are counted by hash prefix; a bucket over its capacity is split on the next bit and
   the directory doubles, until every bucket fits. Without a given capacity a bucket takes an even share of
   the entries, BUCKETS buckets for each shuffle partition, so the directory grows with the tasks that read
   it and there are always several buckets for an owner.
3. Each scan task combines its batch first: equal bytes become one candidate (smallest k, number of rows),
   so a text that fills a third of the table reaches its owner as a candidate per batch.
4. Owner tasks take whole buckets, that is key ranges, in hash order. Candidates of one hash form a chain;
   bytes decide which of its texts a candidate is. The chains are the bucket files of the index.
5. Documents meet their chain by sha256. Groups of one need no such meeting and are left out of it.

Defined results: a null text counts as empty, and empty texts are equal; a null doc_id sorts before all
others; of rows that share the smallest doc_id of a group exactly one is kept; texts are read whole, however
long; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import BLANKS, keep_rows, keyed, partitions, stage, table

#: Buckets for each shuffle partition, where no capacity is given.
BUCKETS = 4


def normalised() -> F.Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")


class Directory:
    """Prefix -> bucket after doubling. ``histogram``: {prefix of ``bits`` bits: entries}; no bucket is deeper than bits."""

    def __init__(self, histogram: dict[int, int], capacity: int, bits: int):
        self.bits, self.depth, self.buckets = bits, 0, {(0, 0): sum(histogram.values())}  # (local depth, prefix) -> load
        loads = [dict() for _ in range(bits + 1)]
        for prefix, n in histogram.items():
            for d in range(bits + 1):
                loads[d][prefix >> (bits - d)] = loads[d].get(prefix >> (bits - d), 0) + n
        todo = [(0, 0)]
        while todo:
            depth, prefix = todo.pop()
            if self.buckets[depth, prefix] <= capacity or depth == bits:
                continue
            del self.buckets[depth, prefix]
            self.depth = max(self.depth, depth + 1)  # the directory doubles when a bucket outgrows it
            for half in (2 * prefix, 2 * prefix + 1):
                self.buckets[depth + 1, half] = loads[depth + 1].get(half, 0)
                todo.append((depth + 1, half))

    def column(self, h: F.Column) -> F.Column:
        """The bucket (its number in key order) of a hash."""
        slots: list[int] = []
        for number, (depth, prefix) in enumerate(sorted(self.buckets, key=lambda x: x[1] << (self.bits - x[0]))):
            slots += [number] * (1 << (self.depth - depth))
        if self.depth == 0:
            return F.lit(0)
        index = F.shiftrightunsigned(h, 64 - self.depth).cast("int")
        return F.element_at(F.lit(slots), index + 1)


GROUP = "h long, sha binary, keep_k long, keep_id long, group_size long"


def _combine(batches):
    """Equal bytes of a batch become one candidate."""
    import pyarrow as pa

    for batch in batches:
        first: dict[tuple[int, str], list[int]] = {}
        for h, k, i, text in zip(*(batch.column(n).to_pylist() for n in ("h", "k", "doc_id", "norm")), strict=True):
            if (at := first.get((h, text))) is None:
                first[h, text] = [k, i, 1]
            else:
                first[h, text] = [*min((at[0], at[1]), (k, i), key=lambda x: x[0]), at[2] + 1]
        arrays = [pa.array([h for h, _ in first], pa.int64()), pa.array([t for _, t in first], pa.string())]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([v[n] for v in first.values()], pa.int64()) for n in range(3))], ["h", "norm", "k", "doc_id", "n"])


def _chain(batches):
    """Owner of key ranges; rows arrive in the order of buckets and hashes. Gives a row per text."""
    import hashlib

    import pyarrow as pa

    def out(h, chain):
        return [(h, hashlib.sha256(t).digest(), *v) for t, v in chain.items()]

    def table_of(rows):
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), *[pa.int64()] * 3), strict=True)], ["h", "sha", "keep_k", "keep_id", "group_size"])

    now, chain = None, {}  # bytes -> [smallest k, its doc_id, rows]; the dict compares bytes
    for batch in batches:
        rows = []
        for h, text, k, i, n in zip(batch.column("h").to_pylist(), batch.column("norm").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("k", "doc_id", "n")), strict=True):
            if h != now:
                rows += out(now, chain)
                now, chain = h, {}
            if (at := chain.get(text)) is None:
                chain[text] = [k, i, n]
            else:
                chain[text] = [*min((at[0], at[1]), (k, i), key=lambda x: x[0]), at[2] + n]
        yield table_of(rows)
    yield table_of(out(now, chain))


def exact_groups(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, k) of every row of docs."""
    return _groups(keyed(docs), capacity)


def directory_of(entries: DataFrame, capacity: int | None) -> Directory:
    """Counted at some bits more than even buckets need; a hash is uniform, so no bucket needs many more."""
    hashes = entries.select("h").distinct()
    n = hashes.count()
    capacity = capacity or max(1, -(-n // (BUCKETS * partitions(entries.sparkSession))))
    bits = max(1, n // capacity).bit_length() + 3
    histogram = hashes.groupBy(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("prefix")).count()
    return Directory({r["prefix"]: r["count"] for r in histogram.toLocalIterator()}, capacity, bits)


def _groups(docs_keyed: DataFrame, capacity: int | None) -> DataFrame:
    norm = docs_keyed.withColumn("norm", normalised()).withColumn("h", F.xxhash64("norm"))
    entries = stage(norm.select("k", "doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "entries")
    directory = directory_of(entries, capacity)

    candidates = norm.select("h", "k", "doc_id", "norm").mapInArrow(_combine, "h long, norm string, k long, doc_id long, n long")
    owned = candidates.withColumn("bucket", directory.column(F.col("h"))).repartition(partitions(docs_keyed.sparkSession), "bucket").sortWithinPartitions("bucket", "h")
    chains = stage(owned.drop("bucket").mapInArrow(_chain, GROUP), "chains")

    found = entries.join(chains.where("group_size > 1"), ["h", "sha"], "left")
    single = F.col("keep_k").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_k") == F.col("k"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "k",
    )


def dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows of docs, all their columns, less those that equal a row that stays."""
    rows = keyed(docs, row=True)
    return keep_rows(rows, _groups(rows, capacity).where("kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("k")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)"""
}
