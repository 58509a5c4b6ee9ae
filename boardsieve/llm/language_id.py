"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1- to ``MAX_GRAM``-grams of the lower-cased text with every run of
other characters than letters made one blank, hashed to ``BUCKETS`` columns; a value is the
relative frequency times the inverse document frequency.  The weights are learned with
follow-the-regularised-leader (proximal, per coordinate) under an elastic-net penalty, and the
softmax temperature is fitted afterwards on labelled rows that the weights have not seen.

Document frequencies are counted over all rows that may be learned from.  Weights and temperature are
fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, shared evenly by the languages, chosen by a hash
of the id); every row is predicted from its whole text.

A softmax can't say that a text is in none of the languages.  ``known`` can, whatever their number: the share of the text's
n-grams that ``COMMON`` of the rows to learn from have, drawn towards 1 by ``PRIOR`` n-grams, so that texts too short to
tell are not held unknown.
``least_known`` of the model is ``KNOWN_SHARE`` of the least share among sampled rows the weights have not seen.

Defined cases: a null text or one without letters is ``und`` with score and share 0; ties go to the
first language in code-point order; without any labelled row everything is ``und``.  A row
with a null doc_id is predicted and can be learned from; a column that is called as the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardsieve.llm.common import small_batches, table

UNKNOWN = "und"
#: Bound of the fitting sample, in rows over all languages.
SAMPLE_ROWS = 3000
MAX_GRAM, BUCKETS, SCALE = 4, 1 << 16, 40.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
#: One labelled row in so many is kept from the weights, for the temperature.
CALIBRATE_EVERY = 5
PRIOR, KNOWN_SHARE, COMMON = 30, 0.8, 0.01


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    #: (BUCKETS, labels), inverse document frequencies multiplied in
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: buckets that are common, and the share of such n-grams a text of a learned language has at least
    known: np.ndarray
    least_known: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of non-letters as one blank, blanks at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    out = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[np.uint32(32)], out[keep], [np.uint32(32)]]).astype(np.uint32)


def _buckets(points: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams that start at each position, one array per length."""
    out, mixed = [], np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64)
    for n in range(1, MAX_GRAM + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        mixed = (mixed[:size] * np.uint64(0x100000001B3) + wide[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(48)).astype(np.uint16))
    return out


def sparse_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and relative frequencies of a text; both empty without letters."""
    points = _letters_of(text or "")
    if not len(points):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = np.bincount(np.concatenate(_buckets(points)), minlength=1)
    where = np.flatnonzero(counts)
    return where.astype(np.int32), (counts[where] / counts.sum()).astype(np.float32)


_FEATURES = T.StructType([T.StructField("label", T.StringType()), T.StructField("draw", T.LongType()),
                          T.StructField("buckets", T.BinaryType()), T.StructField("values", T.BinaryType())])


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [sparse_features(t) for t in batch["text"]]
        yield pd.DataFrame({"label": batch["label"], "draw": batch["draw"], "buckets": [b.tobytes() for b, _ in found], "values": [v.tobytes() for _, v in found]})


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket the number of a partition's texts that have it; bucket -1 counts texts with letters."""
    counts, texts = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            where, _ = sparse_features(text)
            counts[where] += 1
            texts += len(where) > 0
    found = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": np.append(found, -1), "docs": np.append(counts[found], texts)})


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts per bucket, and texts with letters, over all rows of ``texts``; the driver gets a number per bucket."""
    summed = texts.select("text").mapInPandas(_bucket_counts, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    counts = np.zeros(BUCKETS + 1, np.int64)
    counts[summed["bucket"].to_numpy()] = summed["docs"].to_numpy()  # -1 is the last place
    return counts[:-1], int(counts[-1])


def known_share(known: int, total: int) -> float:
    return (known + PRIOR) / (total + PRIOR) if total else 0.0


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], held: list[tuple[str, np.ndarray, np.ndarray]], seen: np.ndarray, texts: int) -> LanguageModel:
    """Weights from ``rows`` of (label, buckets, frequencies) in their order, temperature and least share from ``held``;
    ``seen`` of all ``texts`` have a bucket."""
    labels = tuple(sorted({r[0] for r in [*rows, *held]}))
    number = {label: k for k, label in enumerate(labels)}
    idf = np.log((1 + texts) / (1 + seen)) + 1
    gain = idf * SCALE
    k = len(labels)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        shrunk = np.sign(part) * np.maximum(np.abs(part) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, where, values in rows:
            at = np.append(where, BUCKETS)
            x = np.append(values * gain[where], 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[number[label]] -= 1
            step = x[:, None] * error
            square = step * step
            z[at] += step - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    final = weights(np.arange(BUCKETS + 1))
    final_table, bias = (final[:-1] * gain[:, None]).astype(np.float32), final[-1]
    temperature = 1.0
    known = seen >= max(1, COMMON * texts)
    least = min((float(values[known[where]].sum()) for _, where, values in held), default=0.0) * KNOWN_SHARE
    if held:
        scores = np.stack([values @ final_table[where] + bias for _, where, values in held])
        truth = np.array([number[label] for label, _, _ in held])
        grid = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(labels, final_table, bias, temperature, known, least)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model from the labelled rows of ``docs`` (``doc_id``, ``text``, ``lang``); None without any.

    The sample takes each language's rows whose hash draw is below its share of ``sample_rows``,
    so its expected size is the bound whatever the table's size.  Only its features and a count per bucket reach the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("label"), "text",
        F.pmod(F.xxhash64(F.lit("language"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40)).alias("draw"))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not sizes:
        return None
    share = sample_rows / len(sizes)
    limit = F.create_map(*[F.lit(v) for label in sorted(sizes) for v in (label, int(min(1.0, share / sizes[label]) * (1 << 40)))])
    features = labelled.where(F.col("draw") < limit[F.col("label")]).mapInPandas(_feature_rows, _FEATURES).collect()
    rows = sorted(((r["draw"], r["label"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32))
                   for r in features if r["buckets"]), key=lambda r: (r[0], r[1], len(r[2])))
    if not rows:
        return None
    held = [r[1:] for r in rows if r[0] % CALIBRATE_EVERY == 0]
    return train([r[1:] for r in rows if r[0] % CALIBRATE_EVERY] or held, held, *document_frequencies(labelled))


def _predict_batch(texts: pd.Series, model: LanguageModel) -> pd.DataFrame:
    labels, scores, shares = [], [], []
    for text in texts:
        points = _letters_of(text) if isinstance(text, str) else ()
        if not len(points):
            labels.append(UNKNOWN)
            scores.append(0.0)
            shares.append(0.0)
            continue
        total, count, known = np.zeros(len(model.labels)), 0, 0
        for grams in _buckets(points):
            total += np.bincount(grams, minlength=BUCKETS) @ model.table if len(grams) > BUCKETS else model.table[grams].sum(axis=0, dtype=np.float64)
            count += len(grams)
            known += int(model.known[grams].sum())
        p = _softmax((total / count + model.bias) / model.temperature)
        best = int(np.argmax(p))
        labels.append(model.labels[best])
        scores.append(float(p[best]))
        shares.append(known_share(known, count))
    return pd.DataFrame({"lang_pred": labels, "score": scores, "known": shares})


def predict(docs: DataFrame, model: LanguageModel | None, to: str = "language") -> DataFrame:
    """``docs`` with one more column ``to``, a struct of ``lang_pred``, ``score`` and ``known``."""
    if model is None:
        return docs.withColumn(to, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("known")))
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, known double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _predict_batch(texts, model)

    # Marked so that a filter on the result is not pushed below it, which would run it twice.
    return docs.withColumn(to, classify.asNondeterministic()(F.col("text")))


def op10_language_id(spark, folder: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
