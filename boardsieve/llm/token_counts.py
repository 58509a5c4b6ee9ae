"""Token counts with a digest cache.

Every text is joined to stored counts by the digest of its normalised content and the digest
of the tokenizer's version; only distinct texts without a stored count are encoded, and their
counts are appended to the cache.  Normalisation makes null the empty text and changes nothing
else, because any other change could change the count.

Defined cases: a null text counts as empty; equal texts are encoded once however many there
are; a cache folder that does not exist is an empty cache; an empty table appends nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import shared_dir, small_batches, table, text_or_empty

MODEL = "piece_bpe_32k.model"
OVER_LIMIT = 4096
_CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """SHA-256 over the library's name and version and the vocabulary file."""
    import sentencepiece

    return hashlib.sha256(f"sentencepiece {sentencepiece.__version__}\n".encode() + Path(path).read_bytes()).hexdigest()


def read_cache(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)


def _encoder(path: str | None):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        for batch in batches:
            counts = [len(ids) for ids in model.encode(batch["text"].tolist(), num_threads=1)]
            yield pd.DataFrame({"content_digest": batch["content_digest"], "n_tokens": counts})

    return encode


def count_tokens(docs: DataFrame, cache: str, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``content_digest`` and ``n_tokens`` for every row of ``docs``.

    One row per missing digest is chosen before any text is moved: rows are grouped by digest on
    narrow columns, which are combined before the shuffle, and the texts of the chosen rows are
    fetched by (digest, id), so a text that a third of all rows hold lands nowhere in bulk.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(path or model_path())
    whole = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    keyed = whole.select("doc_id", "text", F.sha2("text", 256).alias("content_digest"))
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    chosen = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("chosen_id"))
    misses = chosen.join(known.select("content_digest"), "content_digest", "left_anti").withColumnRenamed("content_digest", "chosen_digest")
    texts = keyed.join(misses, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("content_digest") == F.col("chosen_digest"))).select(
        "content_digest", "text")
    fresh = texts.mapInPandas(_encoder(path), "content_digest string, n_tokens long")
    fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    # Two rows of one digest can only be repeated appends of the same count.  The key is computed
    # anew, so the join exchanges both sides and a digest that many rows have can be split.
    counts = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")).select(
        F.concat("content_digest", F.lit("")).alias("of_digest"), "n_tokens")
    narrow = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("content_digest"))
    return narrow.join(counts, F.col("content_digest") == F.col("of_digest")).drop("of_digest")


def op7_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every document; each corpus keeps its cache in the shared folder."""
    cache = f"{shared_dir(spark)}/token-counts-{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    counted = count_tokens(table(spark, folder, "documents"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))
