"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to character n-grams:
at each place of the word, marked at both ends, the longest known n-gram counts, from ORDERS down to a
single character; a word's score is the mean over its places. A text takes the language with the greatest
sum; its score is that language's posterior under equal priors.

Learning reads text and lang of rows with a language whose crc32(doc_id as text) mod 4 is not 2. It uses a
bounded sample of them: about ``max_docs`` documents of each language, chosen by a hash of doc_id. All words
and n-grams of the sample are learned. Prediction reads whole texts and nothing but texts. A word is a letter
and the letters and combining marks that follow it.

Defined results: null text and texts without a letter give ``und`` with score 0, as does everything if
there is nothing to learn from; a null doc_id is neither held out nor learned from; a language is known as
soon as one of its sampled texts has a word, however rare; equal sums go to the language that sorts first;
texts are read whole, however long; repeated rows are predicted alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import stage, table

ORDERS = 4
UNKNOWN = "und"
#: Words whose scores a task remembers.
MEMORY = 200_000


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _count_words(batches):
    from collections import Counter

    import pyarrow as pa

    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _count_grams(batches):
    from collections import Counter

    import pyarrow as pa

    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for order in range(1, ORDERS + 1):
                for g in grams_of(word, order):
                    counts[lang, order, g] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "order", "gram", "n"])


class Model:
    """Log frequencies by language, for words and for n-grams of each order: an item's row in a matrix."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, int, str, int]]):
        import numpy as np

        self.langs = sorted({lang for lang, _, _ in words} | {lang for lang, *_ in grams})
        self.words, self.word_logs = self._logs(np, words)
        self.grams, logs = {}, []
        for order in range(1, ORDERS + 1):
            of, log = self._logs(np, [(lang, g, n) for lang, o, g, n in grams if o == order])
            self.grams |= {g: i + len(self.grams) for g, i in of.items()}
            logs.append(log)
        self.gram_logs = np.concatenate(logs)

    def _logs(self, np, rows):
        at = {lang: i for i, lang in enumerate(self.langs)}
        of: dict[str, int] = {}
        places = np.array([(of.setdefault(item, len(of)), at[lang]) for lang, item, _ in rows], np.int64).reshape(-1, 2)
        counts = np.zeros((len(of), len(self.langs)))
        np.add.at(counts, (places[:, 0], places[:, 1]), [n for *_, n in rows])
        counts += 0.5
        return of, np.log(counts / counts.sum(0)).astype(np.float32) if len(of) else counts.astype(np.float32)

    def score_word(self, word: str):
        import numpy as np

        known = self.words.get(word)
        if known is not None:
            return self.word_logs[known]
        marked = f"^{word}$"
        total, places = np.zeros(len(self.langs)), 0
        for i in range(len(marked)):
            for order in range(ORDERS, 0, -1):
                if i + order <= len(marked) and (known := self.grams.get(marked[i : i + order])) is not None:
                    total += self.gram_logs[known]
                    places += 1
                    break
        return total / max(1, places)


def learn(docs: DataFrame, max_docs: int = 3_000, seed: int = 11) -> Model:
    """From about ``max_docs`` labelled documents of each language; languages are few."""
    able = docs.where(~held_out()).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    shares = able.groupBy("lang").agg(F.least(F.lit(1.0), max_docs / F.count("*")).alias("share"))
    # narrow rows are joined to the shares, and the few chosen ones, once written, to the texts
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    chosen = stage(able.select("doc_id", "lang").join(stage(shares, "shares"), "lang").where(dealt < F.col("share") * (1 << 20)).select("doc_id", "lang").distinct(), "sample")
    sample = able.join(chosen, ["doc_id", "lang"], "left_semi")
    counted = stage(sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = counted.mapInArrow(_count_grams, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    return Model(sorted(map(tuple, counted.toLocalIterator())), sorted(map(tuple, grams.select("lang", "order", "gram", "n").toLocalIterator())))  # of the sample


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def of(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        m = shared.value
        memory: dict[str, int] = {}
        vectors = np.zeros((1024, len(m.langs)))
        for batch in batches:
            best, scores = [], []
            for x in batch.column("text"):
                counts = Counter(words_of(x.as_py() or ""))
                if not counts or not m.langs:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(memory) > MEMORY:
                    memory.clear()
                at = []
                for w in counts:
                    i = memory.get(w)
                    if i is None:
                        memory[w] = i = len(memory)
                        if i >= len(vectors):
                            vectors = np.concatenate([vectors, np.zeros_like(vectors)])
                        vectors[i] = m.score_word(w)
                    at.append(i)
                sums = np.fromiter(counts.values(), float, len(counts)) @ vectors[at]
                top = int(sums.argmax())
                best.append(m.langs[top])
                scores.append(float(1 / np.exp(sums - sums[top]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
