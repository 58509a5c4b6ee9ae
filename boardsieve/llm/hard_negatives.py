"""Hard-negative mining by Four-Russians scoring.

Components become integers.  For a block of anchors and every group of eight dimensions a table holds the sums of
all 256 subsets of the eight anchor components.  Candidates are packed once into bit planes (two's complement, a byte
per plane and group), so a byte is the subset of dimensions whose component has that bit; the looked-up sums of a
plane are added over the groups and the planes joined by shifting and adding, the sign plane subtracted.  That is the
full inner product of every anchor and candidate, exactly.

Anchors are a stated query set.  They are taken in blocks whose tables stay under ``TABLE_BYTES``; each block passes
twice over the packed candidates: against rows of equal label for the positives, then against rows of other labels
for the negatives inside each positive's band.  A task keeps only the first rows per anchor (or anchor and positive)
it has seen, whatever the number of candidates, and Spark ranks what the tasks return.  The results of each block
are a written table; the driver holds the anchors and positives of one block at a time.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part; shorter vectors
are filled with zeros; a row with null vec_id is no anchor, and comes last among equal scores; rows that repeat a
vec_id are rows of their own, so another one may be its anchor's positive, while equal rows are one anchor but each a
candidate; an anchor without positives or without rows in a band has no result rows; an empty table is an empty
result; a scaled component of 2^31 or more, or a score beyond 64 bits, is an error.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsieve.llm.common import fresh_path, stored, table
from boardsieve.llm.whole_vectors import extent, floored, matrix, usable

SCALE, POSITIVES, NEGATIVES, BAND = 256, 5, 10, (30, 90)
#: Bytes of one block's tables, and candidates scored together.
TABLE_BYTES, _SCORE_ROWS = 32 << 20, 256
_LAST = np.iinfo(np.int64).max


def bit_planes(whole: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (row, plane, group) of integer rows in two's complement, the lowest bit's plane first."""
    return np.stack([np.packbits((whole >> k & 1).astype(np.uint8), axis=1) for k in range(bits)], axis=1)


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """Tables (group, byte, anchor) of the sums of each subset of eight components; the first one is the highest bit."""
    count, width = anchors.shape
    groups = -(-width // 8)
    filled = np.zeros((count, groups * 8), kind)
    filled[:, :width] = anchors
    sums = np.zeros((groups, 256, count), kind)
    for bit in range(8):
        component = filled[:, 7 - bit::8].T[:, None, :]
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + component
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor) of packed candidates and tabled anchors."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, sums.shape[2]), sums.dtype)
    for k in reversed(range(bits)):
        plane = np.zeros_like(total)
        for g in range(groups):
            plane += sums[g][planes[:, k, g]]
        total = -plane if k == bits - 1 else (total << 1) + plane
    return total


class Firsts:
    """Per slot the first ``keep`` of the (score, id) pairs seen: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot = self.score = self.ident = np.empty(0, np.int64)
        self.least, self.last = np.full(slots, -_LAST), np.full(slots, _LAST)  # score and id of the last kept one

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        score = score.astype(np.int64)
        good = (score > self.least[slot]) | ((score == self.least[slot]) & (ident < self.last[slot]))
        if not good.any():
            return
        slot, score, ident = np.r_[self.slot, slot[good]], np.r_[self.score, score[good]], np.r_[self.ident, ident[good]]
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = rank < self.keep
        self.slot, self.score, self.ident = slot[kept], score[kept], ident[kept]
        full = rank == self.keep - 1
        self.least[slot[full]], self.last[slot[full]] = score[full], ident[full]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"slot": self.slot, "score": self.score, "ident": self.ident})


class _Block:
    """Anchors of a block, ordered by label, as it travels to the tasks; tables are built there."""

    def __init__(self, anchors: pd.DataFrame, width: int, bits: int, kind: type):
        self.anchors = anchors.sort_values("label", kind="stable", ignore_index=True)
        self.width, self.bits, self.kind = width, bits, kind
        self.whole = matrix(self.anchors["whole"], width)
        self.planes = [p.tobytes() for p in bit_planes(self.whole, bits)]
        labels = self.anchors["label"].to_numpy(str)
        first = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        self.ranges = {labels[a]: (a, b) for a, b in zip(first, np.r_[first[1:], len(labels)], strict=True)}

    def chunks(self, batches: Iterator[pd.DataFrame]):
        """Candidates of one label each: the label's anchors as a range, ids, packed bytes and planes."""
        for batch in batches:
            for label, rows in batch.groupby("label", sort=False):
                for at in range(0, len(rows), _SCORE_ROWS):
                    part = rows.iloc[at:at + _SCORE_ROWS]
                    planes = np.frombuffer(b"".join(part["planes"]), np.uint8).reshape(len(part), self.bits, -1)
                    yield self.ranges.get(label, (0, 0)), part["ident"].to_numpy(np.int64), part["planes"].to_numpy(), planes


def _positives(block: _Block, keep: int):
    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = subset_sums(block.whole, block.kind)
        own, bytes_of = block.anchors["ident"].to_numpy(np.int64), np.array(block.planes, object)
        best = Firsts(len(own), keep)
        for (low, high), ident, packed, planes in block.chunks(batches):
            if low == high:
                continue
            found = scores(planes, sums[:, :, low:high])
            row, slot = np.nonzero(found >= best.least[low:high])
            same = np.flatnonzero(ident[row] == own[slot + low])  # only rows of the anchor's id can be the anchor itself
            other = np.ones(len(row), bool)
            other[same] = [packed[r] != bytes_of[s + low] for r, s in zip(row[same], slot[same], strict=True)]
            best.add(slot[other] + low, found[row[other], slot[other]], ident[row[other]])
        yield best.frame()

    return mine


def _negatives(block: _Block, lows: np.ndarray, highs: np.ndarray, keep: int):
    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = subset_sums(block.whole, block.kind)
        count, positives = lows.shape
        best = Firsts(count * positives, keep)
        for (low, high), ident, _, planes in block.chunks(batches):
            for begin, end in ((0, low), (high, count)):
                if begin == end:
                    continue
                found = scores(planes, sums[:, :, begin:end])
                for p in range(positives):
                    least = np.maximum(lows[begin:end, p], best.least[begin * positives + p:end * positives:positives])
                    row, slot = np.nonzero((found >= least) & (found <= highs[begin:end, p]))
                    best.add((slot + begin) * positives + p, found[row, slot], ident[row])
        yield best.frame()

    return mine


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "ident")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


_SCHEMA = "slot long, score long, ident long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(packed: DataFrame, block: _Block, positives: int, negatives: int, band: tuple[int, int]) -> DataFrame:
    """The result rows of one block of anchors."""
    found = _ranked(packed.mapInPandas(_positives(block, positives), _SCHEMA), positives).toPandas()
    # Equal copies of an anchor, beside itself, are positives too.
    more = block.anchors["copies"].to_numpy(np.int64).clip(max=positives + 1) - 1
    slot = np.repeat(np.arange(len(more)), more)
    own = pd.DataFrame({"slot": slot, "score": (block.whole.astype(block.kind)**2).sum(axis=1)[slot], "ident": block.anchors["ident"].to_numpy()[slot]})
    found = pd.concat([found[["slot", "score", "ident"]], own]).sort_values(["slot", "score", "ident"], ascending=[True, False, True], ignore_index=True)
    found["at"] = found.groupby("slot").cumcount()
    found = found[found["at"] < positives]
    lows, highs = np.full((len(more), positives), 1), np.zeros((len(more), positives), np.int64)
    place = found["slot"].to_numpy(), found["at"].to_numpy()
    score = found["score"].to_numpy(np.int64)
    lows[place], highs[place] = -(-band[0] * score // 100), band[1] * score // 100
    best = _ranked(packed.mapInPandas(_negatives(block, lows, highs, negatives), _SCHEMA), negatives)
    pairs = pd.DataFrame({"of_slot": place[0] * positives + place[1], "anchor_id": block.anchors["ident"].to_numpy()[place[0]],
                          "positive": found["ident"].to_numpy(), "positive_score": score})
    spark = packed.sparkSession
    named = spark.createDataFrame(pairs, "of_slot long, anchor_id long, positive long, positive_score long")
    known = lambda c: F.when(F.col(c) < int(_LAST), F.col(c))
    return best.join(F.broadcast(named), F.col("slot") == F.col("of_slot")).select(
        "anchor_id", known("positive").alias("positive_id"), "rank", known("ident").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
                   scale: int = SCALE, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per anchor of ``vectors`` (``vec_id``, ``embedding``, ``label``) and each of its first ``positives`` other rows of its label, the
    first ``negatives`` rows of other labels whose score lies within ``band`` percent of the positive's score."""
    spark = vectors.sparkSession
    whole = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(int(_LAST))).alias("ident"), F.col("label").cast("string").alias("label"),
        floored(F.col("embedding"), scale).alias("whole"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    whole = stored(whole, "whole-vectors")
    size = extent(whole)
    width, bits = max(size.width, 1), size.largest.bit_length() + 1
    if width * (size.largest + 1) ** 2 * max(band[1], 1) >= 1 << 63:
        raise ValueError("scores of these vectors don't fit 64 bits")
    kind = np.int32 if width * (size.largest + 1) ** 2 < 1 << 31 else np.int64

    @F.pandas_udf("binary")
    def packed_planes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([p.tobytes() for p in bit_planes(matrix(batch, width), bits)], dtype=object)

    packed = stored(whole.select("ident", "label", packed_planes("whole").alias("planes")), "packed-vectors")
    anchors = whole.where(F.col("is_anchor") & (F.col("ident") < int(_LAST))).groupBy("ident", "label", "whole").agg(F.count("*").alias("copies"))
    per_block = max(1, table_bytes // (-(-width // 8) * 256 * np.dtype(kind).itemsize))
    anchors = stored(anchors, "anchors")
    blocks = -(-anchors.count() // per_block)
    path = fresh_path(spark, "hard-negatives")
    for number in range(blocks):
        chosen = anchors.where(F.pmod(F.xxhash64("ident", "whole"), F.lit(blocks)) == number).toPandas()
        if len(chosen):
            _mined(packed, _Block(chosen, width, bits, kind), positives, negatives, band).write.mode("append").parquet(path)
        else:
            spark.createDataFrame([], _RESULT).write.mode("append").parquet(path)
    return spark.read.schema(_RESULT).parquet(path) if blocks else spark.createDataFrame([], _RESULT)


def op12_hard_negatives(spark, folder: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.id AS anchor, a.label AS own, b.id, b.label, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor, own, id, score FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND n.label <> n.own
WHERE {BAND[0]} * p.score <= 100 * n.score AND 100 * n.score <= {BAND[1]} * p.score
QUALIFY rank <= {NEGATIVES}
"""
