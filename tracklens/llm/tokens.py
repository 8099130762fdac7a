"""Token ids of the byte-level BPE vocabulary, and token counts through a digest cache.

Ids are those of the vocabulary's own library (tokenizers, ``byte_bpe_50k.json``, no added special tokens,
special strings inside texts parsed as that library does by default). They are computed with tiktoken from
the same vocabulary's ranks, several times as fast; the tests hold both libraries against each other. A text
that tiktoken refuses goes to the vocabulary's own library.

Digest cache: a Parquet table (content, tokenizer, n_tokens). ``content`` is the SHA-256 of the normalised
text: the vocabulary has no normaliser, so normalising only makes null an empty text. ``tokenizer`` is the
digest of all that decides an encoding (vocabulary file, ranks, pattern), so another version never meets old
counts. Documents' distinct digests are joined to the stored counts; only misses are encoded, each once: the
row with the smallest key (``keyed``) of a digest fetches its text. Their counts are appended to the cache.
Without misses no text is read again.

Defined results: a null text counts as empty and has no tokens; repeated rows are counted alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import keyed, new_path, stage, table, tokenizer_path

VOCABULARY = "byte_bpe_50k"
LIMIT = 1024
CACHE = "content binary, tokenizer string, n_tokens long"


@lru_cache
def _encoders(root: str | None):
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = tokenizer_path(f"{VOCABULARY}.json", root)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenizer_path(f"{VOCABULARY}.tiktoken", root)).open("rb"))}
    special = {x["content"]: x["id"] for x in json.loads(Path(own).read_text())["added_tokens"]}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), Tokenizer.from_file(own)


def encode(text: str, root: str | None = None):
    """Ids of a text as a uint32 array."""
    import numpy as np

    fast, own = _encoders(root)
    try:
        return fast.encode_to_numpy(text, allowed_special="all")
    except BaseException as e:  # tiktoken's pattern engine gives up on some texts, as a Rust panic
        if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
            raise
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


def version(root: str | None = None) -> str:
    import public_tokenizers

    files = [Path(tokenizer_path(f"{VOCABULARY}.{x}", root)).read_bytes() for x in ("json", "tiktoken")]
    return hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in [*files, public_tokenizers.PATTERN.encode()])).hexdigest()


def open_cache(spark: SparkSession, path: str) -> None:
    """Make an empty cache where there is none."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)


def count_tokens(docs: DataFrame, cache: str, limit: int = LIMIT, root: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs. ``cache``: path of an opened cache."""
    spark = docs.sparkSession
    tokenizer = version(root)
    texts = keyed(docs).select("k", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    content = F.unhex(F.sha2("text", 256)).alias("content")
    named = stage(texts.select("k", "doc_id", content, F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer).select("content", "n_tokens").dropDuplicates(["content"])
    misses = stage(named.groupBy("content").agg(F.min("k").alias("k")).join(stored(), "content", "left_anti"), "misses")

    def lengths(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([len(encode(x.as_py(), root)) for x in batch.column("text")], pa.int64())], ["content", "n_tokens"])

    if not misses.isEmpty():
        chosen = texts.select("k", "text").join(misses, "k").select("content", "text")
        chosen.mapInArrow(lengths, "content binary, n_tokens long").select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # staged, so that plain tables meet here: AQE can split a digest with very many rows
    return named.join(stage(stored(), "counts"), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first."""
    cache = new_path(spark, "token-cache")
    open_cache(spark, cache)
    return count_tokens(table(spark, sf_dir, "documents"), cache)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}
