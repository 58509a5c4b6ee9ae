"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions.  Within a label the vectors
are compared in tiles: every projection of a tile is sorted, a window centred on each query's
value is located by binary search, and a pair is counted once for each projection whose window
holds it.  Pairs with at least ``least_count`` collisions are verified by their exact cosine in
double precision.  The count is calibrated from the binomial law: at the threshold cosine the
difference of two projections is normal with the pair's distance as deviation, so each window
catches it with a known probability, and the count is the largest that keeps ``RECALL`` of
such pairs; closer pairs are caught more often.

A label of n vectors is dealt out as pairs of parts of at most ``PART_ROWS`` rows, so a hot
label is many tasks.  Work within a label grows with the square of its size, which is in the
nature of counting collisions; memory doesn't.  Equal vectors of a label are compared once.
A task returns counts of links and a spanning forest of them, never all pairs.

Defined cases: a null label, a null or zero vector, or one with null or non-finite components
links with nothing; vectors of different lengths are not compared; an empty table is an empty
result; rows that repeat a vec_id count as vectors of their own, and a row with a null one links but names no component;
equal vectors link with each other.  Columns besides the named ones are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import stored, table
from boardsieve.llm.components import connected_components, forest

PROJECTIONS = 32
#: Half width of a window, in distances of a pair at the threshold.
WINDOW = 1.5
RECALL = 0.995
PART_ROWS = 4096
_QUERY_ROWS = 256


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest collision count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def _windows(base: np.ndarray, queries: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per projection: the base rows' ranks, and each query's first rank and window size."""
    ranks = np.empty(base.shape, np.uint16)
    low = np.empty(queries.shape, np.uint16)
    size = np.empty(queries.shape, np.uint16)
    for k in range(base.shape[1]):
        order = np.argsort(base[:, k], kind="stable")
        values = base[order, k]
        ranks[order, k] = np.arange(len(base), dtype=np.uint16)
        first = np.searchsorted(values, queries[:, k] - reach, "left")
        low[:, k] = first
        size[:, k] = np.searchsorted(values, queries[:, k] + reach, "right") - first
    return ranks, low, size


def linked(base: np.ndarray, queries: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, base row) of unit vectors at ``cosine`` or more, by query block."""
    directions = np.random.default_rng(20240607).standard_normal((base.shape[1], PROJECTIONS))
    # The slack covers rounding in the projections, not in the verified cosine.
    reach = WINDOW * math.sqrt(2 - 2 * cosine) + 1e-9
    ranks, low, size = _windows(base @ directions, queries @ directions, reach)
    enough = least_count()
    columns = np.ascontiguousarray(ranks.T)
    for at in range(0, len(queries), _QUERY_ROWS):
        rows = slice(at, at + _QUERY_ROWS)
        counts = np.zeros((len(queries[rows]), len(base)), np.uint8)
        for k in range(PROJECTIONS):
            # Unsigned wrap-around makes one comparison of the two window ends.
            counts += (columns[k][None, :] - low[rows, k][:, None]) < size[rows, k][:, None]
        i, j = np.nonzero(counts >= enough)
        exact = np.einsum("ij,ij->i", queries[i + at], base[j]) >= cosine
        yield i[exact] + at, j[exact]


def _compare_tile(cosine: float):
    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        part = tile["part"].to_numpy()
        ids, copies = tile["node"].to_numpy(), tile["copies"].to_numpy()
        vectors = np.array(tile["embedding"].tolist(), np.float64)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        lower, upper = tile["low"].iloc[0], tile["high"].iloc[0]
        base, queries = np.flatnonzero(part == lower), np.flatnonzero(part == upper)
        partners = np.zeros(len(tile), np.int64)
        label = np.arange(len(tile))
        for q, b in linked(vectors[base], vectors[queries], cosine):
            q, b = queries[q], base[b]
            if lower == upper:
                q, b = q[q != b], b[q != b]
                np.add.at(partners, q, copies[b])
            else:
                np.add.at(partners, q, copies[b])
                np.add.at(partners, b, copies[q])
            label = forest(len(tile), np.r_[np.arange(len(tile)), q], np.r_[label, b])
        some = partners > 0
        return pd.DataFrame({"node": ids[some], "partners": partners[some], "other": ids[label[some]]})

    return compare


def near_vectors(vectors: DataFrame, cosine: float = 0.93, part_rows: int = PART_ROWS) -> DataFrame:
    """``vec_id``, ``n_links`` and ``component_id`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    embedding = F.col("embedding").cast("array<double>")
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(usable, embedding).alias("embedding")).withColumn(
        "class_key", F.when(F.col("embedding").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")), 256)))
    classes = rows.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stored(classes.select("*", F.size("embedding").alias("size"), F.monotonically_increasing_id().alias("node")), "vectors")
    counts = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).select(
        F.col("label").alias("of_label"), F.col("size").alias("of_size"), "parts")
    placed = classes.join(counts, (F.col("label") == F.col("of_label")) & (F.col("size") == F.col("of_size"))).withColumn(
        "part", F.pmod(F.xxhash64("class_key"), F.col("parts")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("part", p).alias("low"), F.greatest("part", p).alias("high")))
    dealt = placed.select("label", "size", "node", "copies", "embedding", "part", F.explode(every).alias("pair")).select(
        "label", "size", "pair.low", "pair.high", "node", "copies", "embedding", "part")
    found = stored(dealt.groupBy("label", "size", "low", "high").applyInPandas(_compare_tile(cosine), "node long, partners long, other long"), "vector-links")
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("class_key", "node", "rep", "copies").join(partners, "node", "left").join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    smallest = named.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("smallest"))
    per_class = named.join(smallest, F.col("component") == F.col("of")).select(
        F.col("class_key").alias("of_class"), (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.col("smallest").alias("component"))
    return rows.join(per_class, F.col("class_key") == F.col("of_class"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))


def op6_embedding_near_dedup(spark, folder: str) -> DataFrame:
    """Links of equal labels at cosine 0.93 over all embeddings."""
    found = near_vectors(table(spark, folder, "embeddings"), cosine=0.93)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP6_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT a AS node, a AS seen FROM links
  UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id)::BIGINT AS n_links,
       COALESCE((SELECT min(seen) FROM reach WHERE reach.node = e.vec_id), e.vec_id)::BIGINT AS component_id,
       COALESCE((SELECT min(seen) FROM reach WHERE reach.node = e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
