"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line (smaller document, or before in the same one) is within its edit bound; the
earliest stays. The bound is a tenth of the shorter line's length, rounded down and at most 1, so that lines
of fewer than ``min_chars`` (10) characters, where an edit makes another line, have bound 0. Lines are the
\\n-separated parts of whole texts and are compared as they are. Blank lines stay.

1. Equal lines are one row: its hash and earliest place, combined before the shuffle.
2. The edit is in one half of a line, so two lines within the distance share the other half. Lines whose
   half, with the length, is nobody else's are done. ``same``: lines of one length; ``less``: a line and
   one with a character less.
3. The others' texts are fetched, and each emits the variants with one character deleted in the half that
   isn't shared, as hashed keys: with the place for ``same``; against the whole shorter line for ``less``.
4. Rows with equal keys meet as the key's earliest line, an aggregate: a key that a million lines share
   gives a million rows, not all their pairs.
5. ``levenshtein`` verifies each line against the earliest line of its key.
6. Occurrences of lines that go are listed by document.

Defined results: a null or empty text has no lines that go; equal rows are in the order of ``keyed``; an empty
table gives an empty result; texts and lines are read whole, however long; other columns pass through
``dedup`` and are ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import keyed, stage, table

MIN_CHARS = 10
ID = ["h1", "h2"]


def _lines(docs_keyed: DataFrame) -> DataFrame:
    """(k, pos, line, n, h1, h2) of every line that isn't blank."""
    lines = docs_keyed.select("k", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("k", "pos", "line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _halves(line: Column, n: Column) -> Column:
    """(key, part) for each half by which a line could have a partner within the distance.

    part: 2 * role + side; role 0 for ``same``, for ``less`` 1 as the longer line and 2 as the shorter; side 0
    if the first half is the shared one. Halves are those of the longer line's length.
    """
    rows = []
    for role, longer in ((0, n), (1, n), (2, n + 1)):
        half = F.floor(longer / 2).cast("int")
        for side, shared in ((0, F.substring(line, F.lit(1), half)), (1, F.substring(line, half + (0 if role == 2 else 1), n))):
            rows.append(F.struct(F.xxhash64(F.lit(min(role, 1)), F.lit(side), longer, shared).alias("key"), F.lit(2 * role + side).alias("part")))
    return F.array(*rows)


def _candidates(lines: DataFrame) -> DataFrame:
    """(h1, part) of lines that share a half with another line of a fitting length."""
    halves = lines.select("h1", F.inline(_halves(F.col("line"), F.col("n"))))
    role = F.floor(F.col("part") / 2)
    shared = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min(role).alias("low"), F.max(role).alias("high"))
    # staged, here and below, so that plain tables meet in joins: AQE can split a key with very many lines
    shared = stage(shared.where((F.col("high") == 0) & (F.col("a") < F.col("b")) | (F.col("low") < F.col("high"))).select("key"), "halves")
    return halves.join(shared, "key", "left_semi").select("h1", "part").distinct()


def _variants(found: DataFrame) -> DataFrame:
    """(key, whole, k, pos, line) of (k, pos, line, part): a row for each deletion, and for whole lines of ``less``."""
    n, half, i = F.char_length("line"), F.floor(F.char_length("line") / 2).cast("int"), F.col("i")
    role, side = F.floor(F.col("part") / 2), F.col("part") % 2
    places = F.when(role == 2, F.array(F.lit(0))).when(side == 0, F.sequence(half + 1, n)).otherwise(F.sequence(F.lit(1), half))
    each = found.select("k", "pos", "line", role.alias("role"), n.alias("n"), F.explode(places).alias("i"))
    before, after = F.substring("line", F.lit(1), i - 1), F.substring("line", i + 1, F.col("n"))
    key = F.when(F.col("role") == 0, F.xxhash64(F.lit(0), i, before, after)).when(F.col("role") == 1, F.xxhash64(F.lit(1), F.concat(before, after))).otherwise(F.xxhash64(F.lit(1), "line"))
    return each.select(key.alias("key"), F.col("role"), "k", "pos")


def near_earlier(docs_keyed: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """(k, pos) of first places of lines with an earlier line at distance 1. distinct: staged (h1, h2, n, k, pos, count)."""
    long_ = _lines(docs_keyed).where(F.col("n") >= min_chars)
    parts = distinct.where(F.col("n") >= min_chars).join(_candidates(long_), "h1").groupBy("k", "pos").agg(F.collect_set("part").alias("parts"))
    asked = parts.groupBy("k").agg(F.collect_list(F.struct("pos", "parts")).alias("asked"))  # places in one document
    texts = docs_keyed.select("k", F.split("text", "\n").alias("lines")).join(asked, "k")
    one = texts.select("k", "lines", F.inline("asked")).select("k", "pos", F.element_at("lines", F.col("pos") + 1).alias("line"), "parts")
    one = stage(one, "lines")
    variants = stage(_variants(one.select("k", "pos", "line", F.explode("parts").alias("part"))), "variants")

    place = F.struct("k", "pos")
    whole = F.col("role") == 2
    # a line of ``same`` or a whole line meets those with deletions; one with a deletion meets whole lines
    least = variants.groupBy("key").agg(F.min(F.when(~whole, place)).alias("deleted"), F.min(F.when(whole, place)).alias("whole"), F.count("*").alias("n"))
    least = stage(least.where("n > 1").drop("n"), "earliest")
    met = variants.join(least, "key").withColumn("first", F.when(F.col("role") == 1, F.col("whole")).otherwise(F.col("deleted")))
    pairs = met.where(F.col("first") < place).select("k", "pos", F.col("first.k").alias("k2"), F.col("first.pos").alias("pos2")).distinct()
    texts2 = one.select(F.col("k").alias("k2"), F.col("pos").alias("pos2"), F.col("line").alias("line2"))
    checked = pairs.join(one.select("k", "pos", "line"), ["k", "pos"]).join(texts2, ["k2", "pos2"])
    return checked.where((F.levenshtein("line", "line2", 1) >= 0)).select("k", "pos").distinct()


def dropped_lines(docs_keyed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, pos) of every line that goes."""
    every = _lines(docs_keyed).select("k", "pos", *ID, "n")
    distinct = stage(every.groupBy(*ID).agg(F.min(F.struct("k", "pos")).alias("f"), F.count("*").alias("count"), F.min("n").alias("n")).select(*ID, "n", "f.k", "f.pos", "count"), "distinct-lines")
    near = near_earlier(docs_keyed, distinct, min_chars).withColumn("near", F.lit(True))
    judged = distinct.join(near, ["k", "pos"], "left").where("near OR count > 1")
    first = judged.select(*ID, F.col("k").alias("first_k"), F.col("pos").alias("first_pos"), F.coalesce("near", F.lit(False)).alias("near"))
    met = every.select("k", "pos", *ID).join(first, ID)
    return met.where(F.col("near") | (F.col("k") != F.col("first_k")) | (F.col("pos") != F.col("first_pos"))).select("k", "pos")


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) of every row of docs; dropped: places from 0, in order."""
    rows = keyed(docs)
    gone = dropped_lines(rows, min_chars).groupBy("k").agg(F.array_sort(F.collect_list("pos")).alias("dropped"))
    count = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    found = rows.select("k", "doc_id", count.alias("n_lines")).join(gone, "k", "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.concat_ws(",", F.transform("dropped", lambda x: x.cast("string"))), F.lit("")).alias("dropped"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all rows and columns, without the lines that go from text."""
    rows = keyed(docs, row=True)
    gone = dropped_lines(rows, min_chars).groupBy("k").agg(F.collect_set("pos").alias("dropped"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i))
    cut = rows.select("k", "text", "_row").join(gone, "k", "left").select("_row", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.concat_ws("\n", left)).alias("text"))
    return cut.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH parts AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts),
written AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ 	-
]')),
one AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS first FROM written GROUP BY line),
halves AS (
  SELECT line, n, first, n AS longer, 0 AS kind, unnest([0, 1]) AS side, unnest([left(line, n // 2), substr(line, n // 2 + 1)]) AS half FROM one WHERE n >= 10
  UNION ALL
  SELECT line, n, first, n, 1, unnest([0, 1]), unnest([left(line, n // 2), substr(line, n // 2 + 1)]) FROM one WHERE n >= 10
  UNION ALL
  SELECT line, n, first, n + 1, 1, unnest([0, 1]), unnest([left(line, (n + 1) // 2), substr(line, (n + 1) // 2)]) FROM one WHERE n >= 10),
near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.longer = b.longer AND a.kind = b.kind AND a.side = b.side AND a.half = b.half AND b.first < a.first
  WHERE CASE WHEN a.n = b.n THEN a.kind = 0 AND len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) = 1
        WHEN a.n > b.n THEN a.kind = 1 AND len(list_filter(range(1, a.n + 1), lambda i: left(a.line, i - 1) || substr(a.line, i + 1) = b.line)) > 0
        ELSE a.kind = 1 AND len(list_filter(range(1, b.n + 1), lambda i: left(b.line, i - 1) || substr(b.line, i + 1) = a.line)) > 0 END),
gone AS (
  SELECT w.doc_id, w.pos FROM written w JOIN one ON w.line = one.line LEFT JOIN near ON near.line = w.line
  WHERE near.line IS NOT NULL OR w.doc_id * 1000000 + w.pos > one.first)
SELECT p.doc_id, CASE WHEN p.text = '' THEN 0 ELSE len(p.lines) END::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_dropped, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos), '') AS dropped
FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id GROUP BY ALL"""
}
