"""Benchmark decontamination: which documents hold a passage close to a benchmark item.

Words are lower-cased runs of ASCII letters, digits and underscores and of characters beyond ASCII.  For every item size, windows of
that many words get a SimHash fingerprint of their word shingles; a multi-index over blocks of
the items' fingerprints finds every item of the size within the radius; and candidates are
verified by the exact weighted similarity of their shingles (sum of the smaller counts over sum
of the larger).  A window is only fingerprinted if it holds as many shingles of any items as
that similarity needs, which loses nothing.  A document shorter than an item is one window.

The radius is wide for the threshold: fingerprints of texts of similarity 0.8 differ in 9.7 of
64 bits on average with a deviation of 2.9, and the default of 19 is over three deviations more.

The benchmark is read in blocks of at most about ``BLOCK_BYTES`` of text, each shipped to all
tasks, and documents are scanned once for all blocks; there is no shuffle.

Defined cases: null and empty documents hold nothing; items that are null or have no word are
never found; items of fewer words than a shingle are one shingle; equal items are each found;
of several places the most similar, then the first, is reported; an empty benchmark finds
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import small_batches, table
from boardsieve.llm.hashing import range_hashes

BLOCK_BYTES = 4 << 20
RADIUS, INDEX_BLOCKS = 19, 4
_FILTER_BITS = 20

#: Whether a byte belongs to a word; every byte of a character beyond ASCII does.
_IN_WORD = np.array([chr(i).isalnum() or i == 0x5F or i >= 0x80 for i in range(256)])


def word_hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.r_[False, _IN_WORD[data], False].view(np.int8))
    return range_hashes(data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` successive words."""
    count = max(len(words) - size + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = (out ^ words[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` shingle hashes from each start; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        until = int(np.searchsorted(starts, starts[at] + 4096))
        first, last = starts[at], starts[until - 1] + size
        bits = np.unpackbits(hashes[first:last].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        low = starts[at:until] - first
        out[at:until] = np.packbits((sums[low + size] - sums[low]) * 2 > size, axis=1).view(">u8").ravel().astype(np.uint64)
        at = until
    return out


@dataclass(frozen=True)
class SizeIndex:
    """Items of one size: ids, fingerprints, shingle hashes, and a multi-index of fingerprint blocks."""

    shingle: int
    count: int
    ids: np.ndarray
    prints: np.ndarray
    hashes: list[np.ndarray]

    def near(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius.

        Two fingerprints within it differ in at most radius // blocks bits of some block, so only
        pairs that are so close in a 16-bit block are compared in full.
        """
        width = 64 // INDEX_BLOCKS
        close = np.zeros((len(prints), len(self.prints)), bool)
        for block in range(INDEX_BLOCKS):
            cut = lambda x, b=block: (x >> np.uint64(b * width)).astype(np.uint16)
            close |= np.bitwise_count(cut(prints)[:, None] ^ cut(self.prints)[None, :]) <= radius // INDEX_BLOCKS
        window, item = np.nonzero(close)
        fits = np.bitwise_count(prints[window] ^ self.prints[item]) <= radius
        return window[fits], item[fits]


@dataclass(frozen=True)
class ItemIndex:
    sizes: list[SizeIndex]
    #: Per shingle length: a bit table of hash tops, and the sorted hashes.
    members: dict[int, tuple[np.ndarray, np.ndarray]]


def build_index(items: list[tuple[int, str | None]], words: int = 5) -> ItemIndex:
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, text in items:
        hashed = word_hashes(text)
        if len(hashed) and item_id is not None:
            groups.setdefault(len(hashed), []).append((item_id, hashed))
    sizes, members = [], {}
    for size, group in sorted(groups.items()):
        k = min(words, size)
        hashes = [shingles(h, k) for _, h in group]
        count = size - k + 1
        prints = np.concatenate([window_prints(h, np.array([0]), count) for h in hashes])
        sizes.append(SizeIndex(k, count, np.array([i for i, _ in group], np.int64), prints, hashes))
        members.setdefault(k, []).extend(hashes)
    tables = {}
    for k, hashes in members.items():
        known = np.unique(np.concatenate(hashes))
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[known >> np.uint64(64 - _FILTER_BITS)] = True
        tables[k] = (bits, known)
    return ItemIndex(sizes, tables)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two bags of hashes."""
    both, side = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(side[:len(a)], minlength=len(both))
    y = np.bincount(side[len(a):], minlength=len(both))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


def leaks(text: str | None, index: ItemIndex, similarity: float, radius: int) -> dict[int, tuple[float, int]]:
    """Per item found: its greatest similarity and the first word of that window."""
    words = word_hashes(text)
    best: dict[int, tuple[float, int]] = {}
    bags, sums = {}, {}
    for k, (bits, known) in index.members.items():
        bag = shingles(words, k)
        hit = bits[bag >> np.uint64(64 - _FILTER_BITS)]
        where = np.flatnonzero(hit)
        hit[where] = known[np.minimum(np.searchsorted(known, bag[where]), len(known) - 1)] == bag[where]
        if hit.any():
            bags[k], sums[k] = bag, np.r_[0, np.cumsum(hit)]
    for items in index.sizes:
        if items.shingle not in bags:
            continue
        bag, total = bags[items.shingle], sums[items.shingle]
        size = min(items.count, len(bag))
        least = math.ceil(similarity * (items.count + size) / (1 + similarity) - 1e-9)
        if total[-1] < least or least > size:
            continue
        starts = np.flatnonzero(total[size:] - total[:len(total) - size] >= least)
        window, item = items.near(window_prints(bag, starts, size), radius) if len(starts) else ((), ())
        for w, i in zip(window, item, strict=True):
            start = int(starts[w])
            found = weighted_similarity(bag[start:start + size], items.hashes[i])
            number = int(items.ids[i])
            if found >= similarity and (number not in best or (-found, start) < (-best[number][0], best[number][1])):
                best[number] = (found, start)
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded expected size, one after another on the driver."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(count):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block) if count > 1 else benchmark
        yield [(r["item_id"], r["text"]) for r in chosen.select("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = RADIUS, to: str = "leaks") -> DataFrame:
    """``docs`` with column ``to``: arrays ``items``, ``similarities`` and ``starts`` (first words), ordered by item."""
    small_batches(docs.sparkSession)
    indexes = [build_index(items, words) for items in _blocks(benchmark)]

    @F.pandas_udf("items array<long>, similarities array<double>, starts array<int>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found: dict[int, tuple[float, int]] = {}
                for index in indexes:
                    for item, (value, start) in leaks(text if isinstance(text, str) else None, index, similarity, radius).items():
                        if item not in found or (-value, start) < (-found[item][0], found[item][1]):
                            found[item] = (value, start)
                rows.append(sorted((k, *v) for k, v in found.items()))
            yield pd.DataFrame({"items": [[r[0] for r in x] for x in rows], "similarities": [[r[1] for r in x] for x in rows],
                                "starts": [[r[2] for r in x] for x in rows]})

    return docs.withColumn(to, search.asNondeterministic()(F.col("text")))


def op3_decontamination(spark, folder: str) -> DataFrame:
    """Pairs of documents and the benchmark items they hold, at similarity 0.8 of 5-word shingles."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, folder, "benchmark"))
    pairs = found.select("doc_id", F.explode(F.arrays_zip("leaks.items", "leaks.similarities", "leaks.starts")).alias("leak"))
    return pairs.select("doc_id", F.col("leak.items").alias("item_id"), F.col("leak.similarities").alias("similarity"), F.col("leak.starts").alias("start_word"))
