"""Quality rules: an isolation forest on rule statistics, thresholds calibrated from labelled rows.

Words are runs of other than ASCII white space. Base rule: fewer than 50 words, or over half of the words
in repeated 3-word windows, fails a document. All others are judged by an isolation forest: trees split
rule statistics (ratios, so that length alone says nothing) at random; a document that a few random
splits set apart is an anomaly. Each family of statistics (``FAMILIES``) has its trees and its threshold,
so that an odd but harmless trait (digits, say) doesn't mask one that the labels condemn. The forests are
fitted on a bounded sample of the documents (about ``trees`` x ``sample`` rows, chosen by a hash of
doc_id, so the same at any partitioning); scores and base statistics cover every whole text of every
document. Thresholds come from the scores of all labelled rows, as histograms: of the scores at which at
most ``max_loss`` of the good rows are lost, the one that best tells bad from good rows; a family whose
anomalies aren't mainly bad rows rejects nothing.

Defined results: a null text has no words and fails the base rule; labels that are null, or of unknown
documents, count for nothing; without labelled rows of both kinds thresholds are ``DEFAULT_THRESHOLD``;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import keep_rows, keyed, stage, table

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
DEFAULT_THRESHOLD = 0.75
#: Of a score, for the calibration's histograms.
STEPS = 2000
FEATURES = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "mark_ratio", "digit_ratio"]
FAMILIES = {"symbols": ["symbol_ratio"], "repetition": ["repeat_ratio", "dup_line_ratio"], "shape": ["mean_word", "upper_ratio", "mark_ratio", "digit_ratio"]}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?;:\"()[]{}=+/\\_~^@`"


def rule_stats(text: str | None) -> tuple:
    """STATS, then FEATURES, of one whole text."""
    import numpy as np

    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols, dup_lines = count(SYMBOLS), len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]  # so that no product overflows
        _, at, times = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        again = times[at] >= 2
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        repeated = int(covered.sum())
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(FEATURES))
    return n, chars, symbols, dup_lines, repeated, symbols / n, dup_lines / len(lines), repeated / n, chars / n, count(_UPPER) / chars, count(_MARKS) / n, count(_DIGITS) / chars


def document_stats(docs_keyed: DataFrame) -> DataFrame:
    """(k, doc_id, STATS, FEATURES) of every document."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [rule_stats(x.as_py()) for x in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [()] * (len(STATS) + len(FEATURES))
            kinds = [pa.int64()] * len(STATS) + [pa.float64()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["k", "doc_id", *STATS, *FEATURES])

    schema = "k long, doc_id long, " + ", ".join(f"{x} long" for x in STATS) + ", " + ", ".join(f"{x} double" for x in FEATURES)
    return docs_keyed.select("k", "doc_id", "text").mapInArrow(of, schema)


class IsolationForest:
    """Trees over random splits of a bounded sample; ``score`` near 1 for rows that few splits isolate."""

    def __init__(self, rows, trees: int, sample: int, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.size = max(2, min(sample, len(rows)))
        self.depth = int(np.ceil(np.log2(self.size)))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=len(rows) < self.size)], rng) for _ in range(trees)] if len(rows) else []

    def _grow(self, rows, rng):
        """Arrays (feature, split, left child, leaf's path length); the right child follows the left one."""
        import numpy as np

        feature, split, left, length, todo = [-1], [0.0], [0], [0.0], [(0, rows, 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(open_):
                length[node] = depth + average_path(len(part))
                continue
            f = int(rng.choice(open_))
            at = float(rng.uniform(low[f], high[f]))
            feature[node], split[node], left[node] = f, at, len(feature)
            for half in (part[part[:, f] <= at], part[part[:, f] > at]):
                if not len(half):  # the draw was an end of the range
                    half = part[:1]
                todo.append((len(feature), half, depth + 1))
                feature.append(-1), split.append(0.0), left.append(0), length.append(0.0)
        return tuple(map(np.array, (feature, split, left, length)))

    def score(self, rows):
        import numpy as np

        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                down = left[node] + (rows[every, np.maximum(f, 0)] > split[node])
                node = np.where(f < 0, node, down)
            total += length[node]
        return 2.0 ** (-total / max(1, len(self.trees)) / average_path(self.size))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    import math

    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_forests(stats: DataFrame, trees: int, sample: int, seed: int) -> dict[str, IsolationForest]:
    """On about trees x sample rows that a hash of doc_id chooses among those that pass the base rule."""
    import numpy as np

    able = stats.where(~base_failed())
    share = min(1.0, trees * sample / max(1, able.count()))
    chosen = able.where(F.pmod(F.xxhash64(F.coalesce("k", F.lit(-1)), F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select("k", *FEATURES)
    rows = np.array([r[1:] for r in sorted(map(tuple, chosen.toLocalIterator()))], float).reshape(-1, len(FEATURES))
    return {name: IsolationForest(rows[:, [FEATURES.index(x) for x in of]], trees, sample, seed) for name, of in FAMILIES.items()}


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scored(stats: DataFrame, forests: dict[str, IsolationForest]) -> DataFrame:
    """stats with each forest's score as anomaly_<family>."""
    shared = stats.sparkSession.sparkContext.broadcast(forests)  # bounded by trees x sample
    new = [f"anomaly_{name}" for name in FAMILIES]

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            scores = [shared.value[name].score(np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in features], 1)) for name, features in FAMILIES.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores)], [*batch.schema.names, *new])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + "".join(f", {x} double" for x in new)
    return stats.mapInArrow(of, schema)


def calibrate(judged: DataFrame, labels: DataFrame, max_loss: float, price: float = 20.0) -> dict[str, float]:
    """Each family's threshold: most bad rows caught, less ``price`` times the good ones lost (as shares)."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    step = lambda name: F.struct(F.lit(name).alias("family"), F.least(F.floor(F.col(f"anomaly_{name}") * STEPS), F.lit(STEPS)).cast("int").alias("step"))
    rows = judged.where(~base_failed()).join(known, "doc_id").select("quality", F.inline(F.array(*map(step, FAMILIES)))).groupBy("family", "quality", "step").count().collect()  # 2 x STEPS rows a family at most
    out = {}
    for name in FAMILIES:
        counts = {q: {r["step"]: r["count"] for r in rows if (r["family"], r["quality"]) == (name, q)} for q in (0, 1)}
        n = {q: sum(counts[q].values()) for q in (0, 1)}
        if not n[0] or not n[1]:
            out[name] = DEFAULT_THRESHOLD
            continue
        shares, best, out[name] = {0: 0.0, 1: 0.0}, 0.0, 2.0  # no score reaches 2
        for at in range(STEPS, -1, -1):
            shares = {q: shares[q] + counts[q].get(at, 0) / n[q] for q in (0, 1)}
            if shares[1] > max_loss:
                break
            if (gain := shares[0] - price * shares[1]) > best:
                best, out[name] = gain, at / STEPS
    return out


def judge(docs_keyed: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, max_loss: float = 0.01, seed: int = 7) -> DataFrame:
    """(k, doc_id, STATS, base_failed, kept, scores) of every document."""
    stats = stage(document_stats(docs_keyed), "rule-stats")
    judged = stage(scored(stats, fit_forests(stats, trees, sample, seed)), "anomalies")
    odd = F.lit(False)
    for name, threshold in calibrate(judged, labels, max_loss).items():
        odd = odd | (F.col(f"anomaly_{name}") >= threshold)
    return judged.select("k", "doc_id", *STATS, base_failed().alias("base_failed"), (~base_failed() & ~odd).alias("kept"), *[f"anomaly_{x}" for x in FAMILIES])


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all their columns, that the rules keep."""
    rows = keyed(docs, row=True)
    return keep_rows(rows, judge(rows, labels, **settings).where("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(keyed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")).drop("k")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE_SQL: dict[str, str] = {}
