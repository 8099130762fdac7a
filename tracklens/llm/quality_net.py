"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into chunks of CHUNK bytes that start HOP bytes apart, so that they overlap and cover
all of it; the last one is padded. Bytes become learned vectors, learned filters of WIDTH bytes run over a chunk at
every STRIDE bytes, and each filter keeps its greatest response in the chunk. A dense layer reads these responses;
the mean over a text's chunks and its greatest values over them are combined into one probability that the text is
of quality 1. Any text has at least one chunk, if of padding alone, so empty texts have a score as well.

Learning reads text and quality of rows whose crc32(doc_id as text) mod 5 is not 0: a bounded sample of about
``max_docs`` of each quality, chosen by a hash of doc_id, each text whole. The net is fitted in the driver (the
sample's bytes, some 20 MB, are its bound), a fixed number of rounds from a fixed seed, in an order of the rows that
doesn't depend on partitions; rarer labels weigh no more than they occur. Scores read texts only, a slab of
chunks at a time: a text takes the same memory however long it is. A score has six places.

Defined results: a null text is an empty one; a null doc_id is neither held out nor learned from; labels other than 0
and 1, and of unknown documents, count for nothing; a document with several labels has the greatest; with labels of one
kind only, or none, every score is the share of label 1 (0.5 without labels); repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import stage, table

CHUNK, HOP, WIDTH, STRIDE = 512, 448, 8, 2
VECTOR, FILTERS, HIDDEN = 8, 32, 16
PAD = 256
#: Chunks that go through the net at once; least score of a text that counts as good.
SLAB, THRESHOLD = 64, 0.3


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def chunk_count(size: int) -> int:
    return 1 if size <= CHUNK else 1 + -(-(size - CHUNK) // HOP)


def chunks_of(raw: bytes):
    """A text's chunks as a matrix of byte numbers, PAD behind its end."""
    import numpy as np

    n = chunk_count(len(raw))
    padded = np.full((n - 1) * HOP + CHUNK, PAD, np.int16)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


class ByteNet:
    """Weights and passes. ``prior`` is what every score is where the net wasn't fitted."""

    NAMES = ["vectors", "filters", "bias", "dense", "dense_bias", "mean_weight", "max_weight", "last"]

    def __init__(self, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        size = lambda *shape, fan: rng.normal(0, 1 / np.sqrt(fan), shape).astype(np.float32)
        self.vectors = size(PAD + 1, VECTOR, fan=1)
        self.filters, self.bias = size(WIDTH * VECTOR, FILTERS, fan=WIDTH * VECTOR), np.zeros(FILTERS, np.float32)
        self.dense, self.dense_bias = size(FILTERS, HIDDEN, fan=FILTERS), np.zeros(HIDDEN, np.float32)
        self.mean_weight, self.max_weight, self.last = size(HIDDEN, fan=HIDDEN), size(HIDDEN, fan=HIDDEN), np.zeros(1, np.float32)
        self.prior: float | None = None

    def windows(self, chunks):
        """(chunks, places, WIDTH * VECTOR): what the filters see."""
        import numpy as np

        embedded = self.vectors[chunks].reshape(len(chunks), -1)
        return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]

    def responses(self, chunks):
        """(chunks, places, FILTERS): each filter's response at each place, before the bias."""
        import numpy as np

        seen = np.ascontiguousarray(self.windows(chunks))
        return (seen.reshape(-1, WIDTH * VECTOR) @ self.filters).reshape(len(chunks), -1, FILTERS)

    def hidden(self, pooled):
        import numpy as np

        return np.maximum(np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias, 0)

    def score(self, raw: bytes) -> float:
        """A text's probability of quality 1; slab by slab."""
        return self.scores([raw])[0]

    def scores(self, texts: list[bytes]) -> list[float]:
        """Of several texts; short ones share slabs."""
        import numpy as np

        if self.prior is not None:
            return [self.prior] * len(texts)
        sums, tops, counts = np.zeros((len(texts), HIDDEN)), np.zeros((len(texts), HIDDEN), np.float32), np.zeros(len(texts))

        def flush():
            h = self.hidden(self.responses(np.concatenate(held)).max(1))
            owner = np.array(owners)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            own = owner[first]
            sums[own] += np.add.reduceat(h, first, axis=0)
            tops[own] = np.maximum(tops[own], np.maximum.reduceat(h, first, axis=0))
            counts[own] += np.diff(np.r_[first, len(owner)])
            held.clear(), owners.clear()

        held: list = []
        owners: list[int] = []
        for i, raw in enumerate(texts):
            n = chunk_count(len(raw))
            for at in range(0, n, SLAB):
                part = chunks_of(raw[at * HOP : (min(at + SLAB, n) - 1) * HOP + CHUNK])
                held.append(part)
                owners += [i] * len(part)
                if len(owners) >= SLAB:
                    flush()
        if owners:
            flush()
        logit = (sums / counts[:, None]) @ self.mean_weight + tops @ self.max_weight + self.last[0]
        return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6).tolist()

    def gradients(self, texts: list, weights, labels):
        """(loss, gradients by name) of a batch of chunk matrices; the loss is the weighted log loss."""
        import numpy as np

        chunks = np.concatenate(texts)
        counts = np.array([len(t) for t in texts])
        first, owner = np.r_[0, np.cumsum(counts)[:-1]], np.repeat(np.arange(len(texts)), counts)
        best = np.empty((len(chunks), FILTERS), np.int64)
        pooled = np.empty((len(chunks), FILTERS), self.filters.dtype)
        for at in range(0, len(chunks), SLAB):
            r = self.responses(chunks[at : at + SLAB])
            best[at : at + SLAB] = r.argmax(1)
            pooled[at : at + SLAB] = np.take_along_axis(r, best[at : at + SLAB, None], 1)[:, 0]
        active = np.maximum(pooled + self.bias, 0)
        before = active @ self.dense + self.dense_bias
        h = np.maximum(before, 0)
        mean = np.add.reduceat(h, first, axis=0) / counts[:, None]
        top = np.maximum.reduceat(h, first, axis=0)
        logit = mean @ self.mean_weight + top @ self.max_weight + self.last[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -(weights * np.where(labels > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum()
        kind = self.filters.dtype
        d = (weights * (p - labels)).astype(kind)
        g = {"mean_weight": d @ mean, "max_weight": d @ top, "last": d.sum(keepdims=True)}
        dh = (d / counts)[owner, None] * self.mean_weight
        is_top = h == top[owner]
        share = np.add.reduceat(is_top.astype(kind), first, axis=0)  # equal greatest values share
        dh = dh + is_top * (d[:, None] * self.max_weight / share)[owner]
        dh = np.where(before > 0, dh, 0).astype(kind)
        g["dense"], g["dense_bias"] = active.T @ dh, dh.sum(0)
        dp = np.where(pooled + self.bias > 0, dh @ self.dense.T, 0).astype(kind)
        g["bias"] = dp.sum(0)
        g["filters"], g["vectors"] = np.zeros_like(self.filters), np.zeros_like(self.vectors)
        at_byte = best[..., None] * STRIDE + np.arange(WIDTH)  # bytes under each filter's best place
        for f in range(FILTERS):
            some = np.flatnonzero(dp[:, f])
            under = chunks[some[:, None], at_byte[some, f]]
            seen = self.vectors[under].reshape(len(some), WIDTH * VECTOR)
            g["filters"][:, f] = dp[some, f] @ seen
            back = (dp[some, f, None] * self.filters[:, f]).reshape(-1, VECTOR)
            for j in range(VECTOR):
                g["vectors"][:, j] += np.bincount(under.ravel(), back[:, j], PAD + 1)
        return loss, g


def fit_net(texts: list[bytes], labels: list[int], shares: tuple[float, float] | None = None, rounds: int = 8, least_steps: int = 600, batch: int = 32, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """A net fitted by Adam in ``rounds`` over all texts, more for few texts (``least_steps``); ``shares`` are the
    labels' true shares, where the texts are a sample by label."""
    import numpy as np

    net, rng = ByteNet(seed), np.random.default_rng(seed)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        net.prior = float(y.mean()) if len(y) else 0.5
        return net
    shares = shares or (1 - y.mean(), y.mean())
    weight = np.where(y > 0, shares[1] / y.mean(), shares[0] / (1 - y.mean()))
    net.last[:] = np.log(shares[1] / shares[0])
    cut = [chunks_of(t) for t in texts]
    first = {n: 0.0 for n in net.NAMES}
    second = dict(first)
    batches = -(-len(y) // batch)
    rounds = max(rounds, -(-least_steps // batches))
    steps, total = 0, rounds * batches
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            _, g = net.gradients([cut[i] for i in own], weight[own] / len(own), y[own])
            steps += 1
            now = rate * min(1, steps / 20) * (1 - steps / (total + 1))
            for n in net.NAMES:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                step = now * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.999**steps)) + 1e-8)
                setattr(net, n, (getattr(net, n) - step).astype(np.float32))
    return net


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 2_000, seed: int = 5, **settings) -> ByteNet:
    """From about ``max_docs`` labelled documents of each quality, none of them held out."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where(~held_out())
    known = stage(known, "known")
    n = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    share = F.when(F.col("quality") == 1, max_docs / max(1, n.get(1, 0))).otherwise(max_docs / max(1, n.get(0, 0)))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    chosen = stage(known.where(dealt < share * (1 << 20)), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = sorted(map(tuple, texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").toLocalIterator()))  # 2 * max_docs rows
    if not sum(n.values()):
        return fit_net([], [])
    shares = tuple(n.get(q, 0) / sum(n.values()) for q in (0, 1))
    return fit_net([t.encode() for _, t, _ in rows], [q for *_, q in rows], shares, seed=seed, **settings)


def score(docs: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, held_out, score) of every row of docs."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text")
            found = []
            for at in range(0, len(texts), 256):
                found += net.scores([x.as_py() or b"" for x in texts[at : at + 256]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, score double")


def op13_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op13_quality_net": op13_quality_net}
ORACLE_SQL: dict[str, str] = {}
