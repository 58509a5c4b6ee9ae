"""Near-duplicate, repeat and decontamination operators against brute force."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from boardsieve.llm import decontaminate, embedding_dedup, repeats, simhash
from boardsieve.llm.components import connected_components, forest

DOCS = "doc_id long, text string, lang string, node long"


def _components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_forest_and_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (500, 600)]
    expected = _components({x for p in links for x in p}, links)
    label = forest(700, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert all(label[i] == c for i, c in expected.items())
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    looped = {i for a, b in links if a == b for i in (a,)}
    assert {i: c for i, c in found.items()} == {i: c for i, c in expected.items() if i in found}
    assert set(expected) - set(found) <= looped
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _texts(rng, count):
    words = [f"w{i}" for i in range(400)] + ["Ähre", "ÄHRE", "New\tYork"]
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.5:
            copy = rng.choice(texts).split(" ")
            if len(copy) > 3 and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30, 200, 400]))))
    return texts


def test_simhash_links_all_within_radius(spark):
    texts = _texts(random.Random(1), 300)
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)] + [(2000, None, None, None), (2001, "", "", 0), (2001, "", "", 0), (2002, "A b", "", 0), (2003, "a B", "", 0)]
    expected_print = {i: _fingerprint(t) for i, t, _, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(expected_print, 2) if (expected_print[a] ^ expected_print[b]).bit_count() <= 2]
    expected = _components(expected_print, links)
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, bits=64, radius=2).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: int(r["print"].hex(), 16) for r in found} == expected_print
    assert {r["doc_id"]: r["component"] for r in found} == expected
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_hot_tiles_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, size=3, dtype=np.uint64)
    values = np.unique(np.array([int(v) ^ (1 << int(b)) ^ (1 << int(c)) for v in base for b, c in rng.integers(0, 60, (60, 2))], np.uint64))
    rows = [(int(k), int(v).to_bytes(8, "big"), int(v).bit_count(), 1) for k, v in enumerate(values)]
    keyed = spark.createDataFrame(rows, "node long, print binary, ones int, key long")
    for limit in (4096, 20):
        tiles = simhash.tiles(keyed, 2, limit).repartition("key", "tile").sortWithinPartitions("key", "tile").select("key", "tile", "node", "print")
        links = [tuple(r) for r in tiles.mapInPandas(simhash._compare(2, 64), "a long, b long").collect()]
        brute = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (int(values[a]) ^ int(values[b])).bit_count() <= 2]
        assert _components(range(len(values)), links) == _components(range(len(values)), brute)
        assert len(links) <= len(values) * (1 if limit > 1000 else 40)


def test_simhash_tiles_of_one_row(spark):
    none = simhash._links_in_tiles(np.arange(3), np.arange(3, dtype=np.uint64).reshape(3, 1), 2)
    assert [len(x) for x in none] == [0, 0]
    rows = [(7, "just one text of a few words", "", 0)]
    assert [r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()] == [7]
    apart = [(i, " ".join(f"{i}w{k}" for k in range(40)), "", 0) for i in range(3)]
    found = simhash.near_duplicates(spark.createDataFrame(apart, DOCS), words=5, bits=256, radius=54, bands=10).collect()
    assert sorted((r["doc_id"], r["component"]) for r in found) == [(0, 0), (1, 1), (2, 2)]
    # The last row of a partition is left over as a frame of its own.
    batch = lambda keys, at: pd.DataFrame({"key": keys, "tile": 0, "node": range(at, at + len(keys)), "print": [bytes(8)] * len(keys)})
    batches = [batch([0] * 16384, 0), batch([0] * 10 + [1], 16384)]
    links = list(simhash._compare(2, 64)(iter(batches)))
    assert [len(x) for x in links] == [16393, 0]


def test_simhash_bands_find_similar_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(30)]
    near = [[rng.choice(words) if k in (50, 150) else w for k, w in enumerate(b)] for b in base]
    rows = [(i, " ".join(t), "", 0) for i, t in enumerate(base + near)]
    found = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=5, bits=256, radius=54, bands=10).collect()}
    assert found == {i: i % 30 for i in range(60)}


NEAR = dict(words=5, bits=256, radius=72, bands=10, similarity=0.8)


def _similar(texts):
    """Components of texts (word lists) by exact similarity of their 5-word shingle sets."""
    sets = [{tuple(t[k:k + 5]) for k in range(max(len(t) - 4, 1))} for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return _components(range(len(texts)), links)


@pytest.mark.parametrize("set_rows", [512, 6, 2])
def test_near_copies_are_verified(spark, monkeypatch, set_rows):
    monkeypatch.setattr(simhash, "SET_ROWS", set_rows)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(30_000)}"
    texts = []
    for fresh in (20, 45, 55, 90, 130):  # texts of a template: similarity 0.88 down to 0.4 to each other
        shared = [word() for _ in range(300)]
        texts += [shared[:300 - fresh] + [word() for _ in range(fresh)] for _ in range(8)]
    for _ in range(10):  # 4 of 5 shingles shared
        texts += [(short := [word() for _ in range(8)]), [*short, word()]]
    same = "a b c d e f".split() * 60  # mostly equal words beside distinct ones
    texts += [same + [word() for _ in range(100)] for _ in range(2)] + [[]]
    rows = [(i, " ".join(t), "", 0) for i, t in enumerate(texts)]
    kept = simhash.without_near_copies(spark.createDataFrame(rows, DOCS), **NEAR)
    assert kept.columns == ["doc_id", "text", "lang", "node"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(_similar(texts).values()))


@pytest.mark.parametrize("keys", [200_000, 0])
def test_near_copies_with_any_ids_and_names(spark, monkeypatch, keys):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
    rng = random.Random(3)
    texts = [[f"v{rng.randrange(9000)}" for _ in range(200)] for _ in range(6)]
    near = [[*t[:120], "new", *t[121:]] for t in texts]
    text = lambda t: " ".join(t)
    rows = [(None, text(texts[0])), (None, text(near[0])), (5, text(texts[1])), (5, text(near[1])), (None, text(texts[2])), (9, text(near[2])),
            (3, text(texts[3])), (3, text(texts[3])), (3, text(texts[3])), (4, text(texts[4])), (4, text(texts[5])), (8, None), (7, ""), (None, None),
            (6, text(texts[4]) + " " + " ".join(f"long{k}" for k in range(50_000)))]
    frame = spark.createDataFrame([(i, t, "x", n, "lost") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lost_id string, copy_key int, LOST_KEY string")
    found = simhash.without_near_copies(frame, **NEAR)
    assert found.columns == frame.columns
    kept = sorted((str(r["doc_id"]), (r["text"] or "").split()[:1], len(r["text"] or "")) for r in found.collect())
    keep = lambda i, t: (str(i), t[:1], len(text(t)))
    first = min((near[0], texts[0]), key=lambda t: spark.sql("SELECT xxhash64(:t) AS h", {"t": text(t)}).first()["h"])
    second = min((near[1], texts[1]), key=lambda t: spark.sql("SELECT xxhash64(:t) AS h", {"t": text(t)}).first()["h"])
    assert kept == sorted([keep(None, first), keep(5, second), keep(9, near[2]), keep(3, texts[3]), keep(4, texts[4]), keep(4, texts[5]), ("7", [], 0),
                           ("6", rows[-1][1].split()[:1], len(rows[-1][1]))])
    assert simhash.without_near_copies(frame.where("doc_id = 0"), **NEAR).count() == 0


def test_recall_at_the_wanted_similarity(spark):
    """Pairs that share 0.8 to 0.81 of their shingles."""
    rng = random.Random(12)
    texts = []
    for _ in range(400):
        base = [f"w{rng.randrange(60_000)}" for _ in range(rng.choice([100, 180, 400]))]
        # One block of c fresh words changes c + 4 of n - 4 shingles; similarity (n - 8 - c) / (n + c).
        fresh = int((len(base) - 8 - 0.8 * len(base)) / 1.8)
        texts += [base, [*base[:40], *(f"w{rng.randrange(60_000)}" for _ in range(fresh)), *base[40 + fresh:]]]
    component = _similar(texts)
    assert sum(component[2 * k] == component[2 * k + 1] for k in range(400)) == 400
    rows = [(i, " ".join(t), "", 0) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in simhash.without_near_copies(spark.createDataFrame(rows, DOCS), **NEAR).collect()}
    assert sum(2 * k in kept and 2 * k + 1 not in kept for k in range(400)) >= 398


def _cut(rows):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(t[p:p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for (i, _), text in zip(rows, texts, strict=True):
        gone = bytearray(len(text))
        for p in range(len(text) - 199):
            if count[text[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [20_000, 7])
def test_repeats_equal_brute_force(spark, split):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    passages = [noise(n) for n in (150, 199, 200, 260, 500)]
    rows = [(i, "".join(rng.choice([noise(rng.randint(0, 300)), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))) for i in range(100)]
    rows += [(500, None), (501, ""), (502, "a" * 1000), (503, "ab" * 300), (504, "a" * 199), (505, "a" * 200), (506, rows[5][1]), (507, rows[5][1]),
             (3, rows[7][1]), (8, rows[8][1]), (None, noise(300) + passages[4]), (None, noise(250) + passages[3]), (600, "x" * 100 + passages[4] + passages[4][:250])]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), split).collect()
    assert sorted(map(tuple, found), key=str) == _cut(rows)


def test_strings_repeated_in_one_shard_and_single_in_another(spark):
    """Shards of one anchor in tasks of their own: ids beyond 2^53 come back whole."""
    rng = random.Random(12)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (210, 300, 420)]
    rows = [(i, "".join(rng.choice(passages)[rng.choice([0, 0, 7, 40]):] + f" {rng.random()} " for _ in range(rng.randint(1, 4)))) for i in range(60)]
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(map(tuple, found), key=str) == _cut(rows)


def test_repeats_of_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string, h long, part int")).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 3000):
        base = rng.integers(97, 100, size=n, dtype=np.uint8)
        data = np.concatenate([base, base[: n // 2], base, np.zeros(3, np.uint8)])
        raw = data.tobytes()
        order = repeats.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda p: raw[p:])

        def common(a, b, raw=raw):
            k = 0
            while k < 200 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            return k

        assert repeats.common_prefixes(data, order).tolist() == [0] + [common(a, b) for a, b in zip(order, order[1:])]


def test_anchors_cover_every_start():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab c", k=n)) for n in (0, 100, 199, 200, 201, 900)] + [b"z" * 700]
    number, h, low, high, place = repeats.anchors(texts)
    starts = collections.defaultdict(dict)
    for n, a, b, c, p in zip(number, low, high, h, place, strict=True):
        assert b <= p <= a + 200 - repeats.GRAM
        starts[n] |= {s: (c, p - s) for s in range(a, b + 1)}
    for n, text in enumerate(texts):
        assert sorted(starts[n]) == list(range(max(len(text) - 199, 0)))
    of_string = {}
    for n, text in enumerate(texts):
        for s, anchor in starts[n].items():
            assert of_string.setdefault(text[s:s + 200], anchor) == anchor


def test_repeats_over_piece_borders(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range((1 << 20) + 900))
    rows = [(1, text), (2, text[(1 << 20) - 300:(1 << 20) + 300] + "!")]
    found = {r["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_removed"], found[1]["n_spans"], found[2]["n_removed"]) == (600, 1, 600)
    assert found[2]["kept_sha256"] == hashlib.sha256(b"!").hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, part string"


@pytest.mark.parametrize("part_rows", [4096, 60])
def test_embeddings_equal_brute_force(spark, part_rows):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 24))
    rows = []
    for i in range(260):
        v = base[i % 40] + rng.standard_normal(24) * (0.12 if i % 3 else 2.0)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 40) % 3 if i % 17 else None, "x"))
    rows += [(900, None, 1, ""), (901, [0.0] * 24, 1, ""), (902, [math.nan] + [1.0] * 23, 1, ""), (903, [None] + [1.0] * 23, 1, ""), (904, [math.inf] + [1.0] * 23, 1, ""),
             (905, rows[1][1], 1, ""), (906, rows[1][1], 1, ""), (907, [2 * x for x in rows[1][1]], 1, ""), (908, [1.0, 2.0], 1, ""), (909, [], 1, "")]
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, label, _ in rows
            if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.93]
    degree = collections.Counter(x for p in links for x in p)
    found = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS), 0.93, part_rows).collect()}
    assert len(found) == len(rows) and sum(degree.values()) > 300
    recall = sum(r["n_links"] for r in found.values()) / sum(degree.values())
    assert 0.98 <= recall <= 1
    assert all(r["n_links"] <= degree[i] for i, r in found.items())
    expected = _components(label, links)
    assert sum(found[i]["component_id"] == c for i, c in expected.items()) >= 0.98 * len(rows)
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i in (900, 901, 902, 903, 904, 908, 909))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_one_id_link_on_their_own(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.01], 1), (9, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (3, [0.01, 1.0], 2)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(tuple(map(str, r)) for r in found.collect()) == sorted(
        tuple(map(str, r)) for r in [(5, 2, 5), (5, 1, 5), (7, 2, 5), (9, 2, 5), (None, 1, 5), (3, 0, 3)])


def test_collision_count_is_calibrated():
    count = embedding_dedup.least_count()
    assert 20 <= count <= 26


def test_leaks_equal_brute_force():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 30, 60])))) for k in range(25)] + [(90, None), (91, "?!"), (92, None)]
    index = decontaminate.build_index(items)
    for _ in range(150):
        body = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            passage = (rng.choice(items[:25])[1] or "").split()
            if rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = "changed"
            if rng.random() < 0.3:
                passage = passage[2:]
            at = rng.randint(0, len(body))
            body[at:at] = passage
        text = "  ".join(body).upper() + "."
        hashed = decontaminate.word_hashes(text)
        expected = {}
        for size in index.sizes:
            bag = decontaminate.shingles(hashed, size.shingle)
            width = min(size.count, len(bag))
            for item, own in zip(size.ids, size.hashes, strict=True):
                best = max((decontaminate.weighted_similarity(bag[s:s + width], own) for s in range(len(bag) - width + 1)), default=0)
                if best >= 0.8 and width:
                    expected[int(item)] = best
        found = decontaminate.leaks(text, index, 0.8, decontaminate.RADIUS)
        assert {k: round(v[0], 9) for k, v in found.items()} == {k: round(v, 9) for k, v in expected.items()}


def test_multi_index_guarantees_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    asked = prints[:100] ^ rng.integers(0, 1 << 63, 100, dtype=np.uint64) & rng.integers(0, 1 << 63, 100, dtype=np.uint64) & rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    index = decontaminate.SizeIndex(5, 1, np.arange(400), prints, [])
    window, item = index.near(asked, 19)
    brute = np.bitwise_count(asked[:, None] ^ prints[None, :]) <= 19
    assert brute.sum() > 50
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(brute)), strict=True))


def test_leaks_of_odd_rows(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away", "x"), (2, None, None), (3, "", "")]
    docs = [(1, "He said: The quick brown FOX jumps over the lazy dog and runs away!", "", 0), (2, None, None, None), (3, "", "", 0), (4, "x " * 30000, "", 0)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, leaks string"))
    assert {r["doc_id"]: r["leaks"]["items"] for r in found.collect()} == {1: [1], 2: [], 3: [], 4: []}
    none = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string"))
    assert all(not r["leaks"]["items"] for r in none.collect())
    assert decontaminate.find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string, leaks string")).count() == 0
