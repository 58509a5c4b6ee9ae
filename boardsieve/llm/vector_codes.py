"""Vector code compression: product codes whose nearest entries are found by an integer Walsh-Hadamard transform.

Components become integers, a vector is cut into equal consecutive parts, and every part is replaced by the number
of its codebook's nearest entry.  The search is exact and without floating point: parts and entries, filled with
zeros to a power of two, are transformed, which multiplies every squared distance by that power.  Squared differences
of the coefficients are accumulated in sequency order (rows of the transform by their number of sign changes), where
smooth parts hold most of their weight; an entry is eliminated as soon as its sum exceeds the full scaled distance of
the row's best guess.  Sums only grow, so an eliminated entry can neither be nearest nor tie.

Training takes a fixed number of rounds.  A task adds up its parts per entry and returns the sums, which Spark adds
further; only the codebooks (``parts`` x ``entries`` x part length numbers, whatever the number of rows) pass
through the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors and a
length that doesn't divide into parts are filled with zeros; rows that repeat a vec_id are rows of their own, in the
first codebook by vec_id and then components; null ids come last there; fewer rows than entries give fewer entries;
sums that need more than 64 bits are computed with Python's integers, a scaled component of 2^31 or more is an error;
an empty table is an empty result with empty codebooks.  Columns besides the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import bounded, stored, table
from boardsieve.llm.whole_vectors import Extent, extent, floored, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows searched together, and coefficients summed for all entries before the first are eliminated.
_SEARCH_ROWS, _FIRST = 256, 8


def sequency(size: int) -> np.ndarray:
    """Rows of the natural transform matrix ordered by sign changes: bit-reversed Gray codes."""
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    bits = size.bit_length() - 1
    return sum((((gray >> k) & 1) << (bits - 1 - k) for k in range(bits)), np.zeros(size, np.int64))


def walsh(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the last axis, filled with zeros to a power of two, in sequency order."""
    width = values.shape[-1]
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((*values.shape[:-1], size), values.dtype)
    out[..., :width] = values
    step = 1
    while step < size:
        pairs = out.reshape(*values.shape[:-1], size // (2 * step), 2, step)
        low, high = pairs[..., 0, :].copy(), pairs[..., 1, :].copy()
        pairs[..., 0, :], pairs[..., 1, :] = low + high, low - high
        step *= 2
    return out[..., sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed parts the nearest of the transformed entries, lowest number first, and its scaled squared distance."""
    size = parts.shape[1]
    numbers, distances = [np.empty(0, np.int64)], [np.empty(0, parts.dtype)]
    for at in range(0, len(parts), _SEARCH_ROWS):
        rows = parts[at:at + _SEARCH_ROWS]
        summed = np.zeros((len(rows), len(entries)), parts.dtype)
        for c in range(min(_FIRST, size)):
            apart = rows[:, c, None] - entries[None, :, c]
            summed += apart * apart
        guess = rows - entries[summed.argmin(axis=1)]
        bound = (guess * guess).sum(axis=1)
        row, entry = np.nonzero(summed <= bound[:, None])
        reached = summed[row, entry]
        low = min(_FIRST, size)
        while low < size:
            high = min(2 * low, size)
            apart = rows[row, low:high] - entries[entry, low:high]
            reached = reached + (apart * apart).sum(axis=1)
            left = reached <= bound[row]
            row, entry, reached, low = row[left], entry[left], reached[left], high
        # The guess itself is always left, so every row has a range here.
        least = np.minimum.reduceat(reached, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
        is_least = reached == least[row]
        row, entry = row[is_least], entry[is_least]
        numbers.append(entry[np.r_[True, row[1:] != row[:-1]]])
        distances.append(least)
    return np.concatenate(numbers), np.concatenate(distances)


def _kind(size: int, largest: int) -> type:
    """64-bit integers if scaled distances fit them, else Python's."""
    return np.int64 if 4 * size**3 * max(largest, 1) ** 2 < 1 << 63 else object


class _Coder:
    """Cuts vectors into parts and finds their codes; travels to the tasks with the codebooks."""

    def __init__(self, books: np.ndarray, largest: int):
        self.books = books
        length = books.shape[2]
        self.size = 1 << max(length - 1, 0).bit_length()
        self.kind = _kind(self.size, largest)
        self.entries = walsh(books.astype(self.kind))

    def cut(self, vectors: pd.Series) -> np.ndarray:
        parts, _, length = self.books.shape
        return matrix(vectors, parts * length, self.kind).reshape(len(vectors), parts, length)

    def codes(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and exact squared distances, a column per part."""
        turned = walsh(cut)
        found = [nearest(turned[:, p], self.entries[p]) for p in range(cut.shape[1])]
        return np.stack([n for n, _ in found], axis=1), np.stack([d // self.size for _, d in found], axis=1)


def _sums(coder: _Coder):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, entries, length = coder.books.shape
        totals, members = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            cut = coder.cut(batch["whole"])
            codes, _ = coder.codes(cut)
            for p in range(parts):
                np.add.at(totals[p], codes[:, p], cut[:, p].astype(np.int64))
                members[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(members)
        yield pd.DataFrame({"part": part, "entry": entry, "totals": list(totals[part, entry]), "members": members[part, entry]})

    return add


def _coded(coder: _Coder):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, apart = coder.codes(coder.cut(batch["whole"]))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": list(codes), "error": apart.sum(axis=1)})

    return code


def _first_books(rows: DataFrame, size: Extent, parts: int, entries: int) -> np.ndarray:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    length = -(-size.width // parts)
    return matrix([r["whole"] for r in first], parts * length).reshape(len(first), parts, length).swapaxes(0, 1).copy()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``label``, ``code`` (entry number per part) and ``error`` (squared distance) of the usable rows of
    ``vectors`` (``vec_id``, ``embedding``, ``label``), and the codebooks: integers by part, entry and position."""
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", floored(F.col("embedding"), scale).alias("whole"))
    kept = stored(kept, "whole-vectors")
    size = extent(kept)
    books = _first_books(kept, size, parts, entries)
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code array<int>, error long"
    if not size.rows:
        return kept.sparkSession.createDataFrame([], schema), books
    for _ in range(rounds):
        summed = kept.select("whole").mapInPandas(_sums(_Coder(books, size.largest)), "part int, entry int, totals array<long>, members long")
        added = summed.select("part", "entry", "members", F.posexplode("totals").alias("at", "total")).groupBy("part", "entry", "at").agg(
            F.sum("total").alias("total"), F.sum("members").alias("members")).toPandas()
        place = tuple(added[c].to_numpy() for c in ("part", "entry", "at"))
        books = books.copy()
        books[place] = added["total"].to_numpy(np.int64) // added["members"].to_numpy(np.int64)
    return stored(kept.mapInPandas(_coded(_Coder(books, size.largest)), schema), "vector-codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark, folder: str) -> DataFrame:
    """Codes of all embeddings in four parts of 256 entries after four rounds."""
    coded, books = compress(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    labels = bounded(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "code-labels")
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """Assignment by the books of round k, and the books of the next round."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT p.id, p.label, p.part, p.v, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
         entry := b.entry)) AS best
  FROM parts p JOIN books{k} b USING (part) GROUP BY ALL),
sums{k} AS (
  SELECT part, best.entry AS entry, place, sum(v[place])::BIGINT AS total, count(*) AS members
  FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS place) GROUP BY ALL),
means{k} AS (SELECT part, entry, list((total - ((total % members) + members) % members) // members ORDER BY place) AS v FROM sums{k} GROUP BY ALL),
books{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(m.v, b.v) AS v FROM books{k} b LEFT JOIN means{k} m USING (part, entry))"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT id, label, part, whole[part * len(whole) // {PARTS} + 1:(part + 1) * len(whole) // {PARTS}] AS v
  FROM kept, (SELECT unnest(range({PARTS})) AS part)),
books0 AS (
  SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry FROM parts) WHERE entry < {ENTRIES}),
{",".join(_sql_round(k) for k in range(ROUNDS + 1))},
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{ROUNDS}),
coded AS (
  SELECT id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY id)
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
