"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles.
Equal fingerprints are one row; the rest are compared in tiles with exclusive-or and bit
counts in numpy, and pairs of tiles, or of row ranges in a tile, whose population counts
differ by more than the radius are skipped, since they can't be within it.

Which rows share a tile:

- ``bands=0``: a fingerprint is cut into radius + 1 blocks; two fingerprints within the radius
  agree in one block at least, so tiles of equal blocks lose no pair.  For small radii.
- ``bands=n``: tiles of equal min-wise shingle pairs, n of them.  For radii so large that blocks
  would be a few bits.  Texts of similarity s agree in one with 1 - (1 - s^2)^n.

A tile of more than ``TILE_ROWS`` rows is dealt out as pairs of sub-tiles by population count
and fingerprint hash, every pair that can hold a link, so a hot tile is many tasks and nothing
is left out.  A task returns a spanning forest of its links, never all pairs.

``without_near_copies`` takes fingerprints, then of distinct shingles, for candidates only.  Texts of equal shingle
sets are one node.  In each tile nodes that fingerprints link are a group; groups of the same nodes, as a close pair
has in most of its tiles, are one.  Only nodes of a group have their texts fetched, one text a node, and the texts of a
group are compared by their exact shingle sets; a group of over ``SET_ROWS`` nodes, which a tile bounds, is dealt out
as all pairs of its parts.  Links of the wanted similarity make the components, whatever the number of copies.

Defined cases: null or a text without words has fingerprint zero, linked like any other; a text
of fewer words than a shingle is one shingle; rows with null doc_id get the component of their
fingerprint, which is null if no row of it has an id; equal rows get equal results.  Of near copies the row with the
smallest doc_id stays, null ids last, then the one with the smaller hash of its text; of equal rows one stays, and
rows of one id are rows of their own.  An empty table is an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import grouped, small_batches, spare, stored, table
from boardsieve.llm.components import connected_components, forest

TILE_ROWS = 4096
#: Rows whose texts one task holds (twice, for a pair of parts).
SET_ROWS = 512
#: Rows whose keys are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 200_000
#: Shingle hashes looked at together; below 256 so that a byte can count them.
_CHUNK = 255


def shingle_digests(text: str | None, words: int, bits: int, seed: int) -> bytes:
    """Digests of a text's shingles, one after another: XXH64, one XXH3 of 128 bits, or two of them."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    ends = list(accumulate([len(p) + 1 for p in parts]))
    starts = [0, *ends[:-1]]
    pieces = [joined[s:e - 1] for s, e in zip(starts, ends[words - 1:] or ends[-1:], strict=False)]
    if bits == 64:
        return b"".join([xxhash.xxh64_digest(p, seed) for p in pieces])
    if bits == 128:
        return b"".join([xxhash.xxh3_128_digest(p, seed) for p in pieces])
    return b"".join([xxhash.xxh3_128_digest(p, s) for p in pieces for s in (seed, seed + 1)])


def majority(digests: bytes, bits: int) -> bytes:
    """The fingerprint of the digests, most significant bit first."""
    size = bits // 8
    rows = np.frombuffer(digests, np.uint8).reshape(-1, size)
    if not len(rows):
        return bytes(size)
    total = np.zeros(bits, np.int64)
    block = 64 * _CHUNK
    for at in range(0, len(rows), block):
        part = np.unpackbits(rows[at:at + block], axis=1)
        short = -len(part) % _CHUNK
        if short:
            part = np.concatenate([part, np.zeros((short, bits), np.uint8)])
        # Eight byte counters are added as one 64-bit number; none passes 255.
        lanes = part.view(np.uint64).reshape(-1, _CHUNK, size).sum(axis=1, dtype=np.uint64)
        total += np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, bits).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(rows)).tobytes()


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 63, size=count, dtype=np.uint64) | np.uint64(1)


def min_bands(digests: bytes, bits: int, bands: int) -> np.ndarray:
    """One key per band: two min-wise values of the shingles and the band's number, hashed."""
    values = np.frombuffer(digests, ">u8")[:: bits // 64].astype(np.uint64)
    if not len(values):
        return np.arange(bands, dtype=np.int64)
    lows = np.array([((values * m) ^ ((values * m) >> np.uint64(29))).min() for m in _multipliers(2 * bands)], np.uint64)
    mixed = (lows[0::2] * np.uint64(0x9E3779B97F4A7C15)) ^ (lows[1::2] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (lows[0::2] >> np.uint64(32))
    return (mixed * np.uint64(2 * bands + 1) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _blocks(prints: pd.Series, radius: int) -> np.ndarray:
    """Keys of the radius + 1 blocks of 64-bit fingerprints: block number above the block's bits."""
    values = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64)
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    keys = [((values >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)) | np.uint64(k << 56) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return np.stack(keys, axis=1).view(np.int64)


def distinct_digests(digests: bytes, bits: int) -> bytes:
    """Each of the digests once, in a fixed order."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, bits // 8)
    return rows[np.unique(np.frombuffer(digests, ">u8")[:: bits // 64], return_index=True)[1]].tobytes()


def fingerprints(docs: DataFrame, words: int, bits: int, seed: int, bands: int = 0, sets: bool = False) -> DataFrame:
    """``doc_id``, ``text_key``, ``print`` (binary) and, with bands, ``keys`` of every row; with ``sets`` of distinct shingles, and their ``set_key``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("print binary, keys array<long>" + (", set_key binary" if sets else ""))
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shingle_digests(t, words, bits, seed) for t in texts]
            if sets:
                found = [distinct_digests(d, bits) for d in found]
            made = pd.DataFrame({"print": [majority(d, bits) for d in found], "keys": [min_bands(d, bits, bands) if bands else None for d in found]})
            yield made.assign(set_key=[xxhash.xxh3_128_digest(d) for d in found]) if sets else made

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), of_texts.asNondeterministic()(F.col("text")).alias("made"))
    return rows.select("doc_id", "text_key", "made.print", *(["made.keys"] if bands else []), *(["made.set_key"] if sets else []))


def _links_in_tiles(key: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked row numbers among rows of equal key; rows are sorted by key.

    Small tiles are compared side by side, row i with row i + 1, i + 2, ...; large ones in row
    blocks over rows sorted by population count, each block with the rows within reach only.
    """
    near = lambda a, b: np.bitwise_count(values[a] ^ values[b]).sum(axis=-1, dtype=np.int32) <= radius
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]  # there may be no tile of two rows
    small = np.repeat(size <= 32, size)
    for apart in range(1, min(32, int(size[size <= 32].max(initial=1)))):
        a = np.flatnonzero((key[apart:] == key[:-apart]) & small[apart:])
        a = a[near(a, a + apart)]
        found_a.append(a)
        found_b.append(a + apart)
    for start, count in zip(first[size > 32], size[size > 32], strict=True):
        rows = np.arange(start, start + count)
        ones = np.bitwise_count(values[rows]).sum(axis=1, dtype=np.int32)
        order = np.argsort(ones, kind="stable")
        rows, ones = rows[order], ones[order]
        part_a, part_b, held = [], [], 0
        for at in range(0, count, 256):
            block = slice(at, min(at + 256, count))
            until = np.searchsorted(ones, ones[block.stop - 1] + radius, "right")
            apart = np.zeros((block.stop - at, until - at), np.uint16)
            for word in values.T:
                apart += np.bitwise_count(word[rows[block], None] ^ word[None, rows[at:until]])
            i, j = np.nonzero(apart <= radius)
            i, j = i[i < j], j[i < j]
            part_a.append(i + at)
            part_b.append(j + at)
            held += len(i)
            if held > 1 << 20:  # reduced to a forest, so that a dense tile stays small
                label = forest(count, np.concatenate(part_a), np.concatenate(part_b))
                part_a, part_b, held = [np.arange(count)[label != np.arange(count)]], [label[label != np.arange(count)]], 0
        found_a.append(rows[np.concatenate(part_a)])
        found_b.append(rows[np.concatenate(part_b)])
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(radius: int, bits: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped(batches, ["key", "tile"]):
            values = np.frombuffer(b"".join(part["print"]), ">u8").astype(np.uint64).reshape(len(part), bits // 64)
            change = (part["key"].to_numpy()[1:] != part["key"].to_numpy()[:-1]) | (part["tile"].to_numpy()[1:] != part["tile"].to_numpy()[:-1])
            a, b = _links_in_tiles(np.r_[0, np.cumsum(change)], values, radius)
            node, number = np.unique(part["node"].to_numpy(), return_inverse=True)
            label = forest(len(node), number[a], number[b])
            moved = label != np.arange(len(node))
            yield pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return compare


def tiles(keyed: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``keyed`` (``key``, ``node``, ``print``, ``ones``) with ``tile``; rows of hot keys once per pair of sub-tiles."""
    hot = keyed.groupBy("key").count().where(F.col("count") > tile_rows).select(
        (F.col("key") + F.lit(0)).alias("hot_key"), F.ceil(F.col("count") / tile_rows).cast("int").alias("parts"))
    width = max(radius, 1)
    lane = F.floor(F.col("ones") / width)
    own = lane * F.col("parts") + F.pmod(F.xxhash64("print"), F.col("parts"))
    others = F.flatten(F.transform(F.array(lane - 1, lane, lane + 1), lambda x: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: x * F.col("parts") + s)))
    pairs = F.transform(others, lambda o: F.least(own, o) * F.lit(1 << 31) + F.greatest(own, o))
    dealt = keyed.join(hot, F.col("key") == F.col("hot_key"), "left")
    return dealt.select("key", "node", "print", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("tile"))


def similar_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sorted unique sets with that share, or more, of their union in common."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order])
    known, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    number = np.split(flat, np.cumsum(size)[:-1])
    label, mark = np.arange(len(sets)), np.zeros(len(known), bool)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in np.flatnonzero(size):
        j = np.arange(i + 1, np.searchsorted(size, size[i] / similarity + 1e-9, "right"))
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        mark[number[i]] = True
        both = np.add.reduceat(mark[np.concatenate([number[k] for k in j])], np.r_[0, np.cumsum(size[j])[:-1]], dtype=np.int64)
        mark[number[i]] = False
        hit = j[both >= similarity * (size[i] + size[j] - both) - 1e-9]
        hit = hit[np.unique(label[hit], return_index=True)[1]]
        found_a.append(np.full(len(hit), order[i]))
        found_b.append(order[hit])
        label[np.isin(label, label[hit])] = label[i]
    return np.concatenate(found_a), np.concatenate(found_b)


def _verify(words: int, seed: int, similarity: float, rows: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped(batches, ["key", "tile", "root", "part"], rows):
            for _, group in part.groupby(["key", "tile", "root", "part"], sort=False):
                sets = [np.unique(np.frombuffer(shingle_digests(t, words, 64, seed), ">u8").astype(np.uint64)) for t in group["text"]]
                a, b = similar_sets(sets, similarity)
                node = group["node"].to_numpy()
                yield pd.DataFrame({"a": node[a], "b": node[b]})

    return verify


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 64, radius: int = 2, seed: int = 42, bands: int = 0) -> DataFrame:
    """``doc_id``, ``text_key``, ``print`` and ``component`` (the smallest doc_id reached by links) for every row of ``docs``."""
    prints = stored(fingerprints(docs, words, bits, seed, bands), "simhash")
    if bands:
        nodes = prints.groupBy("print").agg(F.min("doc_id").alias("node"), F.min_by("keys", F.coalesce("doc_id", F.lit(1 << 62))).alias("keys"))
    else:
        @F.pandas_udf("array<long>")
        def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in batches:
                yield pd.Series(list(_blocks(part, radius)))

        nodes = prints.groupBy("print").agg(F.min("doc_id").alias("node")).withColumn("keys", blocks(F.col("print")))
    nodes = stored(nodes.where(F.col("node").isNotNull()).withColumn("ones", _ones(bits)), "simhash-nodes")
    keyed = nodes.select("node", "print", "ones", F.explode("keys").alias("key"))
    dealt = tiles(keyed, radius).repartition("key", "tile").sortWithinPartitions("key", "tile")
    links = dealt.select("key", "tile", "node", "print").mapInPandas(_compare(radius, bits), "a long, b long")
    components = connected_components(links)
    classes = nodes.join(components, "node", "left").select(F.col("print").alias("class_print"), F.coalesce("component", "node").alias("component"))
    return prints.join(classes, F.col("print") == F.col("class_print"), "left").select("doc_id", "text_key", "print", "component")


def _ones(bits: int) -> Column:
    return sum((F.bit_count(F.conv(F.hex(F.substring("print", at, 4)), 16, 10).cast("long")) for at in range(1, bits // 8, 4)), F.lit(0))


def _group(radius: int, bits: int):
    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped(batches, ["key", "tile"]):
            values = np.frombuffer(b"".join(part["print"]), ">u8").astype(np.uint64).reshape(len(part), bits // 64)
            change = (part["key"].to_numpy()[1:] != part["key"].to_numpy()[:-1]) | (part["tile"].to_numpy()[1:] != part["tile"].to_numpy()[:-1])
            a, b = _links_in_tiles(np.r_[0, np.cumsum(change)], values, radius)
            label = forest(len(part), a, b)
            linked = np.bincount(label, minlength=len(part))[label] > 1
            node = part["node"].to_numpy()
            yield pd.DataFrame({"key": part["key"].to_numpy()[linked], "tile": part["tile"].to_numpy()[linked],
                                "root": node[label[linked]], "node": node[linked]})

    return group


def candidate_groups(keyed: DataFrame, radius: int, bits: int, set_rows: int | None = None) -> DataFrame:
    """``key``, ``tile``, ``root``, ``part`` and ``node`` of groups that fingerprints link within a tile.

    A group is left out if another one has the same nodes.  Nodes of a large group come once per pair of its parts.
    """
    set_rows = set_rows or SET_ROWS
    dealt = tiles(keyed, radius).repartition("key", "tile").sortWithinPartitions("key", "tile").select("key", "tile", "node", "print")
    groups = stored(dealt.mapInPandas(_group(radius, bits), "key long, tile long, root long, node long"), "simhash-groups")
    same = groups.groupBy("key", "tile", "root").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("low"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("high"))
    chosen = same.groupBy("size", "low", "high").agg(F.min(F.struct("key", "tile", "root")).alias("of")).select(
        F.col("of.key").alias("of_key"), F.col("of.tile").alias("of_tile"), F.col("of.root").alias("of_root"),
        F.ceil(F.col("size") / set_rows).cast("int").alias("parts"))
    kept = groups.join(chosen, (F.col("key") == F.col("of_key")) & (F.col("tile") == F.col("of_tile")) & (F.col("root") == F.col("of_root")))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(own, o.cast("long")) * F.lit(1 << 31) + F.greatest(own, o.cast("long")))
    return kept.select("key", "tile", "root", "node", F.explode(pairs).alias("part"))


def _hinted(keys: DataFrame) -> DataFrame:
    """A written table of keys; broadcast if a count proves it small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def lost_rows(docs: DataFrame, words: int, bits: int, radius: int, bands: int, similarity: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Written tables (``lost_id``, ``lost_key``) of near copies that don't stay, and (``lost_id``, ``lost_key``) of rows there are several of."""
    prints = stored(fingerprints(docs, words, bits, seed, bands, sets=True), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    nodes = prints.groupBy("set_key").agg(first, F.first("print").alias("print"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("*", F.monotonically_increasing_id().alias("node"), _ones(bits).alias("ones")), "simhash-nodes")
    groups = stored(candidate_groups(nodes.select("node", "print", "ones", F.explode("keys").alias("key")), radius, bits), "simhash-parts")
    wanted = stored(groups.select("node").distinct().join(nodes, "node").select(
        "node", F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key")), "simhash-wanted")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("copy_key")).join(
        _hinted(wanted), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("copy_key") == F.col("of_key")))
    one = texts.groupBy("node").agg(F.first("text").alias("text"))
    held = groups.join(one, "node").select("key", "tile", "root", "part", "node", "text").repartition("key", "tile", "root", "part")
    held = held.sortWithinPartitions("key", "tile", "root", "part")
    components = connected_components(held.mapInPandas(_verify(words, seed, similarity, SET_ROWS), "a long, b long"))
    named = nodes.select("node", "set_key", "first", "copies").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stays = named.groupBy("component").agg(F.min("first").alias("stays"), F.sum("copies").alias("rows")).where("rows > 1").select(
        F.col("component").alias("of"), "stays")
    touched = stored(named.join(stays, F.col("component") == F.col("of")).select(F.col("set_key").alias("of_set"), "stays"), "simhash-touched")
    rows = prints.join(_hinted(touched), F.col("set_key") == F.col("of_set"))
    stay = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
    lost = rows.where(~stay).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    repeated = prints.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).count().where("count > 1").drop("count")
    return stored(lost, "simhash-lost"), stored(repeated, "simhash-repeated")


def without_near_copies(docs: DataFrame, words: int = 5, bits: int = 256, radius: int = 72, bands: int = 10, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose text has an exact shingle-set similarity of ``similarity`` or more to one that stays,
    directly or through others; the columns stay as they are.

    Texts travel only where they are compared, and the rest of a row if its key is among too many lost ones to be broadcast.
    """
    lost, repeated = lost_rows(docs, words, bits, radius, bands, similarity)
    copy_key, lost_id, lost_key = (spare(docs.columns, c) for c in ("copy_key", "lost_id", "lost_key"))
    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(copy_key) == F.col(lost_key))
    kept = docs.withColumn(copy_key, F.xxhash64("text")).join(_hinted(lost.toDF(lost_id, lost_key)), same, "left_anti")
    if not repeated.isEmpty():
        several = _hinted(repeated.toDF(lost_id, lost_key))
        once = kept.join(several, same, "left_semi").dropDuplicates(["doc_id", copy_key])
        kept = kept.join(several, same, "left_anti").unionByName(once)
    return kept.drop(copy_key)


def op5_simhash_near_dedup(spark, folder: str) -> DataFrame:
    """Every document with its fingerprint of 3-word shingles and its component at 2 or fewer differing bits."""
    found = near_duplicates(table(spark, folder, "documents"), words=3, bits=64, radius=2, seed=42)
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), F.col("component").alias("component_id"))
