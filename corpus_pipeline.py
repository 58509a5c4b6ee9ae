"""A training-data pipeline over ``documents``: stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsieve.llm import decontaminate, language_id, mixing, secret_scan, simhash
from boardsieve.llm.common import fresh_path, spare, table

#: Near duplicates: texts of 5-word similarity 0.8, found by fingerprints of 256 bits of their distinct shingles and verified.
#: At that similarity long texts differ in 39 bits on average with a deviation of 5.7, texts of 4 against 5 shingles
#: in 48 with one of 6.2, so the radius is 3.9 deviations or more beyond.
NEAR = dict(words=5, bits=256, radius=72, bands=10, similarity=0.8)


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Language ID: documents without letters, and those with too few n-grams of the learned languages, go."""
    model = language_id.fit(table(spark, folder, "documents").where(~language_id.held_out(F.col("doc_id"))))
    name = spare(docs.columns, "pipeline_language")
    judged = language_id.predict(docs, model, to=name)
    least = model.least_known if model else 0.0
    kept = judged.where((F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.known") >= least))
    return kept.drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """SimHash near-dedup: of each component of near copies one document stays, the one with the smallest id."""
    return simhash.without_near_copies(docs, **NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage close to a benchmark item go."""
    name = spare(docs.columns, "pipeline_leaks")
    found = decontaminate.find_leaks(docs, table(spark, folder, "benchmark"), to=name)
    return found.where(F.size(f"{name}.items") == 0).drop(name)


def secrets_masked(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secret scans: live-looking credentials are masked in the text; widely copied examples stay."""
    found = secret_scan.with_findings(docs, secret_scan.scan(docs, F.col("doc_id"), F.col("source")))
    live = F.size(F.coalesce(F.col("secret_live"), F.array())) > 0
    text = F.when(live, secret_scan.masked(F.col("text"), F.col("secret_live"))).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(live, F.length(text)).otherwise(F.col("n_chars")).cast("long")}
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mixing: every document as often as the mix takes it, numbered by ``copy``."""
    return mixing.emitted(mixing.mix(docs))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", secrets_masked),
    ("mixing", mixed_sources),
]

#: No SQL: language ID is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
