"""Helpers that the training-data operators share.

Tables in the shared folder
    ``stage`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads it back. That cuts
    the lineage with files that every executor can see, so a lost executor costs no recomputation. The
    folder is read from the session and is set here only where the session has none.

Row keys
    ``keyed`` gives every document a unique long ``k`` that sorts as doc_id does. Where doc_id is unique
    and never null, k is doc_id itself. Otherwise (repeated or null ids) rows are numbered in the order
    (doc_id, nulls first; text), so that any two rows can be told apart.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the operators' contracts define it.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str, row: bool = False) -> DataFrame:
    """(k, doc_id, text, more...), k as the module's docstring says; other columns of docs are left out.

    With ``row`` the whole input row comes along as the struct ``_row``, so that no name of the input
    clashes with a name of an operator; ``_row.*`` gives it back.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more, *[F.struct(*[docs[c] for c in docs.columns]).alias("_row")] * row)
    n = d.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    if n.n == n.named and d.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        return d.withColumn("k", F.col("doc_id"))
    return _numbered(d, [F.col(c).asc_nulls_first() for c in d.columns])


def keep_rows(docs_keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The input rows (of ``keyed(docs, row=True)``) whose k is in kept."""
    return docs_keyed.select("k", "_row").join(kept.select("k"), "k", "left_semi").select("_row.*")


def _numbered(d: DataFrame, order: list[Column]) -> DataFrame:
    """k from 0 in the given order: a range sort, then each partition's rows follow those of the partitions before."""
    parts = partitions(d.sparkSession)
    ranged = stage(d.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranged")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return ranged.join(F.broadcast(starts), "_p").withColumn("k", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 64, spread: Column | None = None) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each key, however many rows a key has.

    Rows of a key are dealt to ``buckets`` by a hash of the columns ``order``, which tell rows apart, or of
    ``spread`` (rows alike in it get neighbouring numbers), and numbered there; a bucket starts after the rows
    of the buckets before it. So no task sorts more than a bucket of a key. The table of starts has a row for
    each key and bucket and is dealt as the window deals the rows, so only it moves for the join. ``df`` is
    read twice, so pass a staged table.
    """
    d = df.withColumn("_b", F.pmod(F.xxhash64(*([spread] if spread is not None else order)), F.lit(buckets)).cast("int"))
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    if keys:
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    else:  # ``buckets`` numbers, summed here
        sizes, start = {r["_b"]: r["_n"] for r in counts.collect()}, []
        for b in range(buckets):
            start.append(start[-1] + sizes.get(b - 1, 0) if b else 0)
        starts = None
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    joined = d.withColumn("_i", within)
    joined = joined.join(starts, [*keys, "_b"]) if keys else joined.withColumn("_start", F.element_at(F.lit(start), F.col("_b") + 1))
    return joined.withColumn(name, (F.col("_start") + F.col("_i")).cast("long")).drop("_b", "_i", "_start")


def components(edges: DataFrame, rounds: int = 40, few: int = 250_000) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes of (a, b) edges.

    Large-star and small-star rounds over staged tables: every round hangs a node's larger neighbours,
    then its smaller ones, on the smallest. A star graph is the fixed point; the number of rounds grows
    with the logarithm of a component's size. A node with many neighbours only needs their minimum, so
    the grouping combines before the shuffle; minima are staged, so that the joins have plain tables on both
    sides and AQE can split a node with very many neighbours.
    """
    now = stage(_local_forest(edges.where("a <> b").select("a", "b")), "edges")
    settled = now.count() <= few  # what is left of so few edges is joined in one task, to the same end
    if settled:
        now = stage(_local_forest(now.coalesce(1)), "edges")
    for _ in range(0 if settled else rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node hang on the smallest of node and neighbours
        least = stage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), "least")
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: a node and its smaller neighbours hang on the smallest of them
        small_least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small_least.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small, "small")
        ends = new.groupBy("a").count().where("count > 1").limit(1)
        deep = new.select(F.col("b").alias("a")).distinct().join(new.select("a").distinct(), "a", "left_semi").limit(1)
        now = new
        if ends.isEmpty() and deep.isEmpty():
            break
    else:
        if not settled:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _local_forest(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges by stars of the same components, so that fewer and flatter edges travel."""

    def forest(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        def stars():
            nodes = [x for x in up if find(x) != x]
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])
            up.clear()
            return out

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := find(a)) != (y := find(b)):
                    up[max(x, y)] = min(x, y)
            if len(up) > 1_000_000:  # bounds the task's memory; the forest so far goes out
                yield stars()
        yield stars()

    return edges.mapInArrow(forest, "a long, b long")


def tokenizer_path(name: str, root: str | None = None) -> str:
    """A vocabulary file of the public tokenizers; ``root`` names another folder of such files."""
    if root is not None:
        return f"{root.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
