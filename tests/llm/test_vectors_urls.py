"""Vector codes, hard negatives and URL filters against brute force and SQL."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from boardsieve.llm import hard_negatives, url_filter, vector_codes
from boardsieve.llm.registry import QUERIES, SQL

VECTORS = "vec_id long, embedding array<float>, label int, whole string, code int, ident int, planes string"
NEW = ("op11_vector_codes", "op12_hard_negatives", "op13_url_filter")


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).map(str).values.tolist()))


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, small, name):
    database = duckdb.connect()
    for table in ("embeddings", "pages"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    assert _rows(QUERIES[name](spark, small).toPandas()) == _rows(database.sql(SQL[name]).df())


def _vectors(rng, count, width=10):
    """Rows with ties, repeated rows and ids, nulls and non-finite components; clashing columns carry other values."""
    rows = []
    for i in range(count):
        if rows and rng.random() < 0.3:
            vector = rng.choice(rows)[1]
        else:
            vector = [rng.choice([-0.5, -0.25, 0.0, 0.3, 0.7, rng.uniform(-1, 1)]) for _ in range(width)]
        rows.append((rng.choice([i, i, i, i - 1]), vector, rng.choice([1, 1, 1, 2, 3, None]), "w", 1, 2, "p"))
    bad = [None, [None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1)]
    rows += [(1000 + i, v, 1, None, None, None, None) for i, v in enumerate(bad)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1, "", 0, 0, "")]
    return rows


def test_walsh_order_and_length():
    for size in (1, 2, 8, 32):
        turned = vector_codes.walsh(np.eye(size, dtype=np.int64))
        changes = [int((np.diff(np.sign(turned[:, k])) != 0).sum()) for k in range(size)]
        assert changes == list(range(size))
    values = np.random.default_rng(1).integers(-9, 9, (5, 11))
    assert ((vector_codes.walsh(values) ** 2).sum(axis=1) == 16 * (values**2).sum(axis=1)).all()


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_is_exact(kind):
    rng = np.random.default_rng(2)
    parts, entries = rng.integers(-3, 4, (1500, 6)), rng.integers(-3, 4, (40, 6))
    exact = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    number, distance = vector_codes.nearest(vector_codes.walsh(parts.astype(kind)), vector_codes.walsh(entries.astype(kind)))
    assert (number == exact.argmin(axis=1)).all()
    assert (distance == 8 * exact.min(axis=1)).all()
    assert vector_codes._kind(16, 1024) is np.int64 and vector_codes._kind(16, 1 << 30) is object


def _brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * np.float64(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * length - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * length:(p + 1) * length]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v, p) for _, v, _ in ordered[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda v: [min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        codes = [(v, find(v)) for _, v, _ in kept]
        for p in range(parts):
            members = collections.defaultdict(list)
            for v, code in codes:
                members[code[p][1]].append(cut(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    found = sorted((str(i), [k for _, k in find(v)], sum(d for d, _ in find(v)), str(label)) for i, v, label in kept)
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("width", [10, 8, 0])
def test_codes_equal_brute_force(spark, width):
    rows = _vectors(random.Random(width), 90, width)
    if width:
        rows.append((55, [2.5], 2, "", 0, 0, ""))
    coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS), parts=4, entries=16, rounds=3, scale=64)
    found = sorted((str(r["vec_id"]), list(r["code"]), r["error"], str(r["label"])) for r in coded.collect())
    expected, digest = _brute_codes(rows, 4, 16, 3, 64)
    assert found == expected
    assert vector_codes.digest(books) == digest


def test_codes_of_edge_tables(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 0, 0, "")], VECTORS))
    assert coded.count() == 0 and books.size == 0
    wide, _ = vector_codes.compress(spark.createDataFrame([(1, [3.0e5, -3.0e5], 1), (2, [3.0e5, 3.0e5], 1)], "vec_id long, embedding array<float>, label int"), entries=1, rounds=0)
    assert sorted(r["error"] for r in wide.collect()) == [0, (6 * 10**5 * 1024) ** 2]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [3.0e30], 1)], "vec_id long, embedding array<float>, label int"))


def test_four_russians_scores():
    rng = np.random.default_rng(3)
    for low, high, width, kind in ((-9, 9, 13, np.int32), (-(1 << 20), 1 << 20, 64, np.int64), (0, 1, 1, np.int64)):
        anchors, rows = rng.integers(low, high, (7, width)), rng.integers(low, high, (30, width))
        bits = int(np.abs(rows).max()).bit_length() + 1
        found = hard_negatives.scores(hard_negatives.bit_planes(rows, bits), hard_negatives.subset_sums(anchors, kind))
        assert (found == rows @ anchors.T).all()


def test_firsts_keep_ties_by_id():
    rng = random.Random(4)
    seen = [(rng.randrange(5), rng.randrange(4), rng.randrange(50)) for _ in range(400)]
    best = hard_negatives.Firsts(5, 6)
    for at in range(0, 400, 37):
        best.add(*(np.array(c) for c in zip(*seen[at:at + 37], strict=True)))
    expected = [(s, *p) for s in range(5) for p in sorted(((v, i) for t, v, i in seen if t == s), key=lambda p: (-p[0], p[1]))[:6]]
    assert list(best.frame().itertuples(index=False, name=None)) == expected


def _brute_negatives(rows, positives, negatives, band, scale):
    kept = []
    for i, v, label, *_ in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i if i is not None else 1 << 62, label, tuple(math.floor(scale * np.float64(np.float32(x))) for x in v)))
    found = []
    for anchor in {r for r in kept if r[0] % 10 == 0 and r[0] < 1 << 62}:
        scored = [(-sum(x * y for x, y in zip(anchor[2], r[2], strict=False)), r[0], r) for r in kept]
        same = sorted((s, i) for s, i, r in scored if r[1] == anchor[1])
        same.remove((-sum(x * x for x in anchor[2]), anchor[0]))
        other = sorted((s, i) for s, i, r in scored if r[1] != anchor[1])
        for score, positive in same[:positives]:
            inside = [(s, i) for s, i in other if band[0] * -score <= 100 * -s <= band[1] * -score][:negatives]
            found += [(anchor[0], positive, n + 1, i, -score, -s) for n, (s, i) in enumerate(inside)]
    null = lambda i: None if i == 1 << 62 else i
    return sorted(tuple(map(str, (a, null(p), n, null(i), s, t))) for a, p, n, i, s, t in found)


@pytest.mark.parametrize("table_bytes", [1 << 20, 1])
def test_negatives_equal_brute_force(spark, table_bytes):
    rows = _vectors(random.Random(6), 160)
    frame = spark.createDataFrame(rows, VECTORS)
    from pyspark.sql import functions as F

    found = hard_negatives.hard_negatives(frame.repartition(3), F.col("vec_id") % 10 == 0, 4, 6, (30, 90), 64, table_bytes)
    expected = _brute_negatives(rows, 4, 6, (30, 90), 64)
    assert len(expected) > 100
    assert sorted(tuple(map(str, r)) for r in found.collect()) == expected
    nothing = hard_negatives.hard_negatives(frame.where("vec_id < 0"), F.col("vec_id") % 10 == 0)
    assert nothing.count() == 0 and nothing.columns == found.columns


def _brute_judge(url, listed, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for sign in "/?#":
        host = host.split(sign, 1)[0]
    path = rest[len(host):]
    for sign in "?#":
        path = path.split(sign, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [(v, r) for v, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    verdict, rule = max(fitting, key=lambda r: len(r[1]), default=(None, None))
    return host, path, rule, verdict or ("block" if host in listed else "allow")


@pytest.mark.parametrize("filter_bytes", [1 << 20, 64])
def test_urls_equal_brute_force(spark, filter_bytes):
    rng = random.Random(7)
    hosts = [f"h{i}.net" for i in range(900)] + ["org", "a.ORG", "Éx.org", "example.org", "example.org.net", "badexample.org", "x.example.org", "a.com", "h\n.net"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "?q=/es/", "#/es/", "/de/x", "/fr/", "//://z"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(1500)]
    urls += [f"http://{h}{t}" for h in hosts[900:] for t in tails] + [None, "", "://", "no scheme", "http://" + "x." * 20000 + "net/" + "y" * 200000]
    listed = {f"h{i}.net" for i in range(0, 400)} | {"not.in.corpus"}
    pages = spark.createDataFrame([(i, u, "own", True) for i, u in enumerate(urls)], "page_id long, url string, url_host string, key boolean")
    names = spark.createDataFrame([(h,) for h in [*listed, "h1.net", None]], "host string")
    found = url_filter.judged(pages, names, filter_bytes=filter_bytes)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["page_id"]: (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in found.collect()}
    assert got == {i: _brute_judge(u, listed, url_filter.RULES) for i, u in enumerate(urls)}


def test_cascade_has_levels_and_edge_lists(spark):
    keys = spark.range(20000).selectExpr("cast(id AS string) AS key", "id % 9 = 0 AS is_listed")
    levels = url_filter.cascade(keys, 17777)
    assert len(levels) > 2
    assert keys.withColumn("found", url_filter._is_member(levels, keys["key"])).where("found <> is_listed").count() == 0
    none = spark.createDataFrame([], "host string")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [r["url_verdict"] for r in url_filter.judged(pages, none).collect()] == ["allow"]
    assert url_filter.judged(pages.where("page_id = 2"), none).count() == 0
    everything = url_filter.judged(pages, spark.createDataFrame([("a.net",)], "host string"))
    assert [r["url_verdict"] for r in everything.collect()] == ["block"]
