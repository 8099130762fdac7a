"""Source divergence audit, over texts that are collapsed before they are read.

Terms are runs of letters: ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. A language keeps the terms
that at least ``MIN_DOCS`` of its documents have. A group is a (lang, source) that occurs; it gives each kept term
p = 1 + floor(10**9 (count + 5) / (N + 5 V)), and so does each language over all its documents.

1. Equal texts of a language become one row with the number of copies in each source: counts of (lang, text,
   source) combine before the shuffle; a text's sources are listed, SOURCES in a list at most on average.
2. Each such text is split into terms once. Tasks add up, for each source, the copies times the occurrences and the
   copies times one (document frequency), and Spark adds the tasks' sums.
3. Pairs of sources are evaluated on entries with a count only. Terms are dealt into chunks of TERMS, sources into
   blocks of BLOCK; a chunk of two blocks is one task's small table, in which a source without an entry has its
   value of no occurrence. Terms that neither block has enter as a product. So a task's memory has a bound, however
   many sources and terms a language has.

All sums are of integers; what could pass a long on the way is a decimal.

Defined results: null text, lang and source are ''; a group without terms has the smoothed value for every kept
term; a language without kept terms has pairs of value 0 and no terms; a language's only source has no pairs; ties
of value go by the item's UTF-8 bytes; repeated rows are documents like others; texts are read whole, in slices,
however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.llm.common import stage, table

MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 10**9, 50
#: Sources in a text's list, terms of a chunk, sources of a block (all on average), a task's sums before they go out.
SOURCES, TERMS, BLOCK, HELD = 1024, 1024, 64, 400_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20

C = F.col


def numbered_sources(docs: DataFrame) -> tuple[DataFrame, int]:
    """(staged (source, sid), seed): sid is a hash of the source, by the first seed for which no two of them share one."""
    sources = stage(docs.select(_text("source")).distinct(), "sources")
    n, seed = sources.count(), 0
    while sources.select(F.xxhash64("source", F.lit(seed))).distinct().count() < n:
        seed += 1
    return sources.select("source", F.xxhash64("source", F.lit(seed)).alias("sid")), seed


def _text(name: str):
    return F.coalesce(C(name).cast("string"), F.lit("")).alias(name)


def collapsed(docs: DataFrame, seed: int, sources: int) -> DataFrame:
    """(lang, text, copies): each text of a language once, with [(sid, n)].

    Texts are shuffled once, by (lang, text), after copies combined. A text of one source has its copies there; of
    the others the copies are counted without the text, by 128 bits of its hashes.
    """
    d = docs.select(_text("lang"), _text("text"), F.xxhash64(_text("source"), F.lit(seed)).alias("sid"))
    key = [F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g")]
    texts = d.groupBy("lang", "text").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("n"))
    single = texts.where("low = high").select("lang", "text", F.array(F.struct(C("low").alias("sid"), "n")).alias("copies"))
    part = F.pmod("sid", F.lit(max(1, -(-sources // SOURCES))))
    counted = d.select("lang", *key, "sid").groupBy("lang", "h", "g", "sid").agg(F.count("*").alias("n"))
    lists = counted.groupBy("lang", "h", "g", part.alias("part")).agg(F.collect_list(F.struct("sid", "n")).alias("copies"))
    # all of the grouping's columns are used on both sides, so that Spark shuffles the texts once for both
    several = texts.where("low <> high AND n > 0").select("lang", "text", *key).join(lists, ["lang", "h", "g"]).select("lang", "text", "copies")
    return single.union(several)


def terms_of(text: bytes):
    """Lists of a text's terms, slice by slice."""
    plain = text.translate(_TERMS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


#: Bytes of terms, A-Z in lower case; all others become blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches):
    """Rows (lang, text, copies) to sums (lang, sid, term, count, docs); term '' stands for the group itself."""
    from collections import Counter

    import pyarrow as pa

    groups: dict[tuple[str, int], tuple[Counter, Counter]] = {}

    def out():
        rows = [(lang, sid, "", 0, 0) for lang, sid in groups]
        for (lang, sid), (counts, docs) in groups.items():
            rows += [(lang, sid, t.decode("utf-8", "replace"), n, docs[t]) for t, n in counts.items()]
        groups.clear()
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "sid", "term", "count", "docs"])

    held = 0
    for batch in batches:
        for lang, text, copies in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("copies"), strict=True):
            counts: Counter = Counter()
            for words in terms_of(text.as_py()):
                counts.update(words)
            for copy in copies.as_py():
                key = lang, copy["sid"]
                if key not in groups:
                    groups[key] = Counter(), Counter()
                total, docs = groups[key]
                n, size = copy["n"], len(total)
                for term, k in counts.items():
                    total[term] += n * k
                    docs[term] += n
                held += len(total) - size
            if held > HELD:
                yield out()
                held = 0
    if groups:
        yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """Staged (lang, source, term, count, docs); every group has a row of the term ''."""
    sources, seed = numbered_sources(docs)
    texts = collapsed(docs, seed, sources.count()).select("lang", C("text").cast("binary").alias("text"), "copies")
    counted = texts.mapInArrow(_count, "lang string, sid long, term string, count long, docs long")
    summed = counted.groupBy("lang", "sid", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return stage(summed.join(sources, "sid").select("lang", "source", "term", "count", "docs"), "term-counts")


def _p(count: str, total: str, kept: str):
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH kept)), null without kept terms."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(38,0)) * ({count} + {SMOOTH})) DIV nullif({total} + {SMOOTH} * {kept}, 0)").cast("long")


def profiles(counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, entries), both staged.

    groups: (lang, source, v, base): kept terms of the language, p of a kept term without occurrence.
    entries: (lang, source, term, p, q): kept terms that occur in the group, p there and in the language.
    """
    real = counts.where("term <> ''")
    kept = stage(real.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).where(C("docs") >= min_docs).select("lang", "term", "lang_count"), "kept-terms")
    met = stage(real.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    totals = met.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "n", "lang_n"])
    groups = stage(groups.select("lang", "source", "v", "n", "lang_n", _p("0", "n", "v").alias("base")), "groups")
    entries = met.join(groups, ["lang", "source"]).select("lang", "source", "term", _p("count", "n", "v").alias("p"), _p("lang_count", "lang_n", "v").alias("q"))
    return groups.select("lang", "source", "v", "base"), stage(entries, "entries")


def _pair_sums(entries, roster):
    """Of one chunk of terms and two blocks of sources: the sum of |p - q| over the chunk's terms, for each pair."""
    import numpy as np
    import pandas as pd

    if not len(roster):
        return pd.DataFrame()
    roster = roster.sort_values("source").reset_index(drop=True)
    base = roster["base"].fillna(0).to_numpy(np.int64)
    terms, column = np.unique(entries["term"].to_numpy(object), return_inverse=True) if len(entries) else ([], np.zeros(0, np.int64))
    p = np.repeat(base[:, None], len(terms), 1)
    row = pd.Index(roster["source"]).get_indexer(entries["source"]) if len(entries) else np.zeros(0, np.int64)
    p[row, column] = entries["p"].to_numpy(np.int64) if len(entries) else 0
    i, j = roster["i"].iloc[0], roster["j"].iloc[0]
    block = roster["b"].to_numpy()
    ones, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
    out = []
    for a in ones:
        b = others[others > a] if i == j else others
        value = np.abs(p[b] - p[a]).sum(1)
        absent = np.abs(base[b] - base[a])
        for x, y in ((np.full(len(b), a), b), (b, np.full(len(b), a))):
            out.append(pd.DataFrame({"source": roster["source"].to_numpy(object)[x], "item": roster["source"].to_numpy(object)[y], "value": value, "absent": absent}))
    made = pd.concat(out) if out else pd.DataFrame(columns=["source", "item", "value", "absent"])
    return made.assign(lang=roster["lang"].iloc[0], seen=len(terms), v=roster["v"].iloc[0])[["lang", "source", "item", "value", "absent", "seen", "v"]]


def source_pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.max("v") / TERMS)).cast("int").alias("chunks"))
    placed = stage(groups.join(langs, "lang").withColumn("b", F.pmod(F.xxhash64("source"), C("blocks")).cast("int")), "blocks")
    other = F.explode(F.sequence(F.lit(0), C("blocks") - 1)).alias("o")
    pair = [F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")]
    chunk = F.pmod(F.xxhash64("term"), C("chunks")).cast("int").alias("chunk")
    left = entries.join(placed.select("lang", "source", "b", "blocks", "chunks"), ["lang", "source"]).select("lang", "source", "term", "p", "b", chunk, other).select("lang", "chunk", *pair, "source", "term", "p")
    right = placed.select("lang", "source", "base", "v", "b", "chunks", other).select("lang", "source", "base", "v", "b", *pair, F.explode(F.sequence(F.lit(0), C("chunks") - 1)).alias("chunk"))
    keys = ["lang", "chunk", "i", "j"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pair_sums, "lang string, source string, item string, value long, absent long, seen long, v long")
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("absent").alias("absent"), F.max("v").alias("v"))
    return whole.select("lang", "source", "item", (C("value") + (C("v") - C("seen")) * C("absent")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group all other sources, and its ``top`` terms above the language."""
    groups, entries = profiles(term_counts(docs), min_docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(groups, entries).withColumn("rank", F.row_number().over(ranked))
    terms = entries.where("p > q").select("lang", "source", C("term").alias("item"), (C("p") - C("q")).alias("value")).withColumn("rank", F.row_number().over(ranked)).where(C("rank") <= top)
    part = lambda d, name: d.select("lang", "source", F.lit(name).alias("part"), "item", "value", C("rank").cast("int").alias("rank"))
    return part(pairs, "pair").union(part(terms, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.n, 0) + {SMOOTH} * l.v) AS p, 1 + ({UNIT}::HUGEINT * (k.n + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= {TOP}"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE_SQL = {"op12_source_divergence": SQL}
