"""Suffix-array dedup: removal of every byte that a long repeated string covers.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else, in the
same document or another.  Strings that may repeat are found by content: the first smallest
hash of ``GRAM`` bytes inside a string is its anchor, so equal strings have equal anchors at
equal places, and each start belongs to one anchor.  Anchors that occur once in the corpus
can't be in a repeated string.  For the others the stretch of text around them (the starts the
anchor stands for and the ``LENGTH`` bytes after the last) is dealt to shards by anchor hash.

A shard collapses equal stretches, builds the suffix array of the rest by Larsson-Sadakane
refinement, where only positions that share their rank are sorted again by the rank a doubled
distance on, and derives common prefixes with Kasai's bound; runs of prefixes of ``LENGTH`` or
more are equal strings.  Anchors with more occurrences than ``SHARD_OCCURRENCES`` are split over
several shards; strings that are single in their shard are then looked up among those of the
other shards by binary search over sorted 128-bit keys.

Texts that several documents hold are processed once: their whole length is repeated.  Texts
move by shuffle on (document, text hash), never by anchor.

Defined cases: null is the empty text; texts below ``LENGTH`` bytes lose nothing; rows that
repeat a doc_id are told apart by their text; equal rows are copies of each other; rows with
null doc_id are treated like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import grouped, small_batches, stored, table, text_or_empty
from boardsieve.llm.hashing import gram_hashes

LENGTH = 200
GRAM = 48
SHARD_OCCURRENCES = 1_000
#: Positions are numbered by the low bits of an anchor candidate; longer texts are cut with overlap.
_PLACE_BITS = 21
_PIECE = 1 << 20
_NO_ID = -(1 << 63)
_ELSEWHERE = -1


def _first_lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each ``width`` neighbours, by running minima from both ends of blocks."""
    count = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1:width - 1 + count])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, first start, last start, anchor place) of every anchor, starts within the text."""
    pieces = []
    for number, text in enumerate(texts):
        pieces += [(number, at, text[at:at + _PIECE + length - 1]) for at in range(0, len(text) - length + 1, _PIECE)]
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    at = 0
    while at < len(pieces):
        until, size = at, 0
        while until < len(pieces) and (until == at or size + len(pieces[until][2]) < _PIECE):
            size += len(pieces[until][2])
            until += 1
        part = pieces[at:until]
        at = until
        sizes = np.array([len(p[2]) for p in part])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        hashes = gram_hashes(data, gram)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        place = (_first_lowest((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & mask).astype(np.int64)
        # Only starts whose string ends in the same piece count.
        starts = np.concatenate([np.arange(e - n, e - length + 1) for n, e in zip(sizes, ends, strict=True)])
        owner = np.repeat(np.arange(len(part)), sizes - length + 1)
        chosen = place[starts]
        first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(starts)] - 1
        shift = np.array([p[1] for p in part])[owner[first]] - (ends - sizes)[owner[first]]
        for column, values in zip(out, (np.array([p[0] for p in part])[owner[first]], hashes[chosen[first]].view(np.int64),
                                        starts[first] + shift, starts[last] + shift, chosen[first] + shift), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        number, h, *_ = anchors([_bytes(t) for t in batch["text"]])
        pairs, times = np.unique(np.stack([number, h], axis=1), axis=0, return_counts=True)
        yield pd.DataFrame({"id": batch["id"].to_numpy()[pairs[:, 0]], "tid": batch["tid"].to_numpy()[pairs[:, 0]], "h": pairs[:, 1], "times": times.astype(np.int32)})


def _stretch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches around the anchors each row names in ``hits``."""
    for batch in batches:
        texts = [_bytes(t) for t in batch["text"]]
        number, h, low, high, _ = anchors(texts)
        parts = [dict(zip((x["h"] for x in hits), (x["parts"] for x in hits), strict=True)) for hits in batch["hits"]]
        rows = [(n, k, a, b, parts[n].get(k)) for n, k, a, b in zip(number.tolist(), h.tolist(), low.tolist(), high.tolist(), strict=True)]
        rows = [r for r in rows if r[4] is not None]
        ids, tids = batch["id"].to_numpy(), batch["tid"].to_numpy()
        yield pd.DataFrame({
            "h": np.array([r[1] for r in rows], np.int64), "part": np.array([(tids[r[0]] ^ r[2]) % r[4] for r in rows], np.int32),
            "parts": np.array([r[4] for r in rows], np.int32), "id": np.array([ids[r[0]] for r in rows], np.int64), "tid": np.array([tids[r[0]] for r in rows], np.int64),
            "low": np.array([r[2] for r in rows], np.int64), "stretch": [texts[r[0]][r[2]:r[3] + LENGTH] for r in rows]})


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zeros beyond the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k:len(data) + k]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of ``data`` in the order of their suffixes, by Larsson-Sadakane refinement.

    Ranks start from eight bytes.  A rank is the last place its group may take; each round sorts
    only the positions that share a rank, by the rank ``distance`` further on, and doubles it.
    Beyond the end the shorter suffix comes first.
    """
    n = len(data)
    first = _words(data)
    order = np.argsort(first)
    fresh = np.r_[True, first[order][1:] != first[order][:-1]]
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(np.r_[starts[1:], n] - 1, np.diff(np.r_[starts, n]))
    places = np.arange(n)
    distance = 8
    open_ = places[np.repeat(np.diff(np.r_[starts, n]) > 1, np.diff(np.r_[starts, n]))]
    while len(open_):
        at = order[open_]
        beyond = at + distance
        further = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], n - 1 - beyond)
        both = (rank[at] << 32) + further  # further lies within n of zero
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[open_] = at
        new = np.r_[True, both[1:] != both[:-1]]
        begin = np.flatnonzero(new)
        sizes = np.diff(np.r_[begin, len(at)])
        rank[at] = np.repeat(open_[begin + sizes - 1], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        distance *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Common prefix of each entry of a suffix array with the entry before, up to ``length``, by Kasai's bound.

    In text order a prefix is at most one shorter than the one before it.  Blocks of the text
    are walked in step: each starts from nothing and then only extends what the bound leaves.
    """
    n = len(data)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    words = np.concatenate([_words(data), np.zeros(length + 8, np.uint64)])
    found = np.zeros(n, np.int64)
    block = 64
    firsts = np.arange(0, n, block)
    held = np.zeros(len(firsts), np.int64)
    for step in range(block):
        at = firsts + step
        inside = at < n
        at = at[inside]
        other = before[at]
        have = np.maximum(held[inside] - 1, 0)
        have[other == n] = 0
        open_ = np.flatnonzero((other < n) & (have < length))
        while len(open_):
            a, b = at[open_] + have[open_], other[open_] + have[open_]
            apart = words[a] ^ words[b]
            # Whole bytes before the first difference; the ends of the text end a prefix.
            same = sum((apart < np.uint64(1 << bits)).astype(np.int64) for bits in range(0, 64, 8))
            have[open_] += np.minimum(same, np.maximum(n - np.maximum(a, b), 0))
            open_ = open_[(same == 8) & (have[open_] < length) & (np.maximum(a, b) + 8 <= n)]
        have = np.minimum(have, length)
        found[at] = have
        held[inside] = have
    return found[order]


def _string_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the strings of ``LENGTH`` bytes at ``starts``."""
    raw = data.tobytes()
    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[s:s + LENGTH], digest_size=16).digest() for s in starts.tolist()), np.int64).reshape(-1, 2)
    return digests[:, 0], digests[:, 1]


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, start) pairs as runs: row, first, last."""
    if not len(row):
        return row, start, start
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    return row[new], start[new], start[np.r_[new[1:], len(row)] - 1]


_FOUND = "id long, tid long, first long, last long, key_a long, key_b long"


def _shard_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated starts of a shard's texts; of split anchors also the keys of all strings, those found or not.

    A row with keys and a start is a string that is single here; one whose start is ``_ELSEWHERE`` says that the
    string occurs here.  Ids are never null in it: Arrow hands a column with nulls to pandas as
    floats, which cut 64-bit numbers.
    """
    for shard in grouped(batches, ["h", "part"], rows=8192):
        codes, stretches = pd.factorize(pd.MultiIndex.from_arrays([shard["h"], shard["part"], shard["stretch"]]))
        copies = np.bincount(codes)
        h = stretches.get_level_values(0).to_numpy()
        texts = stretches.get_level_values(2).tolist()
        sizes = np.array([len(t) for t in texts])
        split = np.zeros(len(texts), bool)
        split[codes] = shard["parts"].to_numpy() > 1
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        count = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(texts)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = begins[owner] + offset
        # Anchors with one stretch have nothing to be compared with; the others go into the array.
        several = (pd.Series(h).groupby(h).transform("size").to_numpy() > 1)[owner]
        number = np.arange(len(at))
        if several.any():
            use = np.flatnonzero((pd.Series(h).groupby(h).transform("size").to_numpy() > 1))
            inner = np.frombuffer(b"".join(texts[k] for k in use), np.uint8)
            moved = np.full(len(texts), -1)
            moved[use] = np.cumsum(sizes[use]) - sizes[use]
            order = suffix_array(inner)
            groups = np.empty(len(inner), np.int64)
            groups[order] = np.cumsum(common_prefixes(inner, order) < LENGTH)
            number[several] = len(at) + groups[moved[owner[several]] + offset[several]]
        _, number = np.unique(number, return_inverse=True)
        times = np.bincount(number, weights=copies[owner]).astype(np.int64)
        repeated = times[number] > 1
        # What is found for a stretch holds for each of its places.
        row, first, last = _runs(owner[repeated], offset[repeated])
        spans = pd.DataFrame({"code": row, "first": first, "last": last})
        places = pd.DataFrame({"code": codes, "id": shard["id"].to_numpy(), "tid": shard["tid"].to_numpy(), "low": shard["low"].to_numpy()})
        found = places.merge(spans, on="code")
        yield pd.DataFrame({"id": found["id"], "tid": found["tid"], "first": found["first"] + found["low"], "last": found["last"] + found["low"],
                            "key_a": np.zeros(len(found), np.int64), "key_b": np.zeros(len(found), np.int64)}).assign(key_a=None, key_b=None)
        wide = np.flatnonzero(split[owner])
        if len(wide):
            _, one = np.unique(number[wide], return_index=True)
            chosen = wide[one]
            key_a, key_b = _string_keys(data, at[chosen])
            single = ~repeated[chosen]
            place = np.zeros(len(texts), np.int64)
            place[codes] = np.arange(len(codes))
            where = place[owner[chosen]]
            start = shard["low"].to_numpy()[where] + offset[chosen]
            start = np.where(single, start, _ELSEWHERE)
            yield pd.DataFrame({"id": shard["id"].to_numpy()[where], "tid": shard["tid"].to_numpy()[where],
                                "first": start, "last": start, "key_a": key_a, "key_b": key_b})


def _merge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted keys from all shards, the single strings that another shard has too."""
    for part in grouped(batches, ["key_a"]):
        keys = np.rec.fromarrays([part["key_a"].to_numpy(), part["key_b"].to_numpy()])
        sorted_keys = np.sort(keys)
        several = np.searchsorted(sorted_keys, keys, "right") - np.searchsorted(sorted_keys, keys, "left") > 1
        yield part.loc[several & (part["first"] != _ELSEWHERE).to_numpy(), ["id", "tid", "first", "last"]]


def _kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            data = np.frombuffer(_bytes(text), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, [s["first"] for s in spans], 1)
            np.add.at(edge, [s["last"] + LENGTH for s in spans], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans_left = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans_left, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pd.DataFrame({"id": batch["id"], "tid": batch["tid"], "n_removed": [o[0] for o in out], "n_spans": [o[1] for o in out], "kept_sha256": [o[2] for o in out]})


def without_repeats(docs: DataFrame, shard_occurrences: int = SHARD_OCCURRENCES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for every row of ``docs`` (``doc_id``, ``text``)."""
    small_batches(docs.sparkSession)
    text = text_or_empty(F.col("text"))
    whole = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text")).withColumn("tid", F.xxhash64("text"))
    narrow = stored(whole.select("doc_id", "id", "tid", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "repeat-texts")
    classes = narrow.groupBy("digest").agg(F.min(F.struct("id", "tid")).alias("rep"), F.count("*").alias("copies"))
    # One text of each class, by (id, tid); rows equal in both stay several, which only adds to their count.
    chosen = classes.select(F.col("rep.id").alias("id"), F.col("rep.tid").alias("tid"), "copies")

    long = whole.where(F.octet_length("text") >= LENGTH)
    rows = long.select("id", "tid", "text").mapInPandas(_anchor_rows, "id long, tid long, h long, times int")
    common = rows.groupBy("h").agg(F.min("tid").alias("low"), F.max("tid").alias("high"), F.max("times").alias("most"), F.sum("times").alias("n")).where(
        (F.col("low") != F.col("high")) | (F.col("most") > 1)).select((F.col("h") + F.lit(0)).alias("of_h"), F.ceil(F.col("n") / shard_occurrences).cast("int").alias("parts"))
    hits = rows.select("id", "tid", "h").join(common, F.col("h") == F.col("of_h")).groupBy("id", "tid").agg(
        F.collect_set(F.struct("h", "parts")).alias("hits")).join(chosen, ["id", "tid"])
    held = stored(long.join(hits, ["id", "tid"]).select("id", "tid", "copies", "text", "hits"), "repeat-candidates")
    stretches = held.select("id", "tid", "text", "hits").mapInPandas(_stretch_rows, "h long, part int, parts int, id long, tid long, low long, stretch binary")
    shards = stretches.repartition("h", "part").sortWithinPartitions("h", "part").mapInPandas(_shard_rows, _FOUND)
    found = stored(shards, "repeat-found")
    open_ = found.where("key_a IS NOT NULL").repartition("key_a").sortWithinPartitions("key_a")
    merged = open_.mapInPandas(_merge_rows, "id long, tid long, first long, last long")
    spans = found.where("key_a IS NULL").select("id", "tid", "first", "last").unionByName(merged)
    by_text = spans.groupBy("id", "tid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    # Of texts with copies all is repeated, so only single ones are cut.
    kept = held.where("copies = 1").select("id", "tid", "text").join(by_text, ["id", "tid"]).mapInPandas(
        _kept_rows, "id long, tid long, n_removed long, n_spans long, kept_sha256 string")
    results = classes.join(kept, (F.col("rep.id") == F.col("id")) & (F.col("rep.tid") == F.col("tid")), "left").select(
        F.concat("digest", F.lit("")).alias("of_digest"), "copies", "n_removed", "n_spans", "kept_sha256")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return narrow.join(results, F.col("digest") == F.col("of_digest")).select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))


def op2_suffix_array_dedup(spark, folder: str) -> DataFrame:
    """Bytes that 200-byte repeats cover, over all documents."""
    return without_repeats(table(spark, folder, "documents"))
