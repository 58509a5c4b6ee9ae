"""URL filters: fixed rules, and a list of keys held in a Bloom filter cascade, DataFrame operations only.

A cascade answers membership exactly for every key of the corpus.  Level 0 encodes the listed keys; the corpus's other
keys that it wrongly accepts are encoded by level 1, the listed ones among those that level 1 wrongly accepts by level
2, and so on until nothing is wrong.  A key is looked up level by level; the number of the first level that refuses it
tells which side it is on, and one that passes all belongs to what the last level encodes.  The key universe is all
distinct keys of the rows to be judged, so no key is outside it.

Levels are built by aggregates: bit positions are hashes, their 64-bit words are combined with ``bit_or`` map-side,
and the words become one array.  Rows read it as a scalar subquery, so judging them neither joins nor shuffles.  A
level travels to every task, so its size is bounded: filters are cut by key hash into as many shards as keep each
one within ``FILTER_BYTES``, and every further shard is one more pass over its rows, with its own cascade.

Rules are few and given as (verdict, host and path).  A rule fits its host and all subdomains if the path starts with
the rule's; the longest fitting rule wins, of equally long ones the first.

Defined cases: a null URL, or one without ``://``, has empty host and path; null keys count as the empty one; listed
keys that no row has, nulls and repeats in the list change nothing; an empty table is an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import stored, table

# Fixed values of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that put a host on the query's list if they stand between its dots and hyphens.
WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")

FILTER_BYTES = 16 << 20
#: False positives of every level but the first, and the largest rate of the first.
RATE, FIRST_RATE = 1 / 16, 1 / 2


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The winning rule as a struct of ``rule`` and ``verdict``, null if none fits."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = rule.partition("/")
        inside = (host == of_host) | F.endswith(host, F.lit("." + of_host))
        fits = F.when(inside & F.startswith(path, F.lit(slash + of_path)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _bits(keys: int, rate: float) -> tuple[int, int]:
    """Bits, in whole words, and number of hashes of a filter."""
    bits = math.ceil(keys * -math.log2(rate) / math.log(2) / 64) * 64
    return bits, max(1, round(-math.log2(rate)))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(n), key), F.lit(bits)) for n in range(hashes)]


def _encoded(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row with the filter of ``keys`` as an array of words."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at"))
    word = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bits"))
    every = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = word.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    return stored(words.agg(gathered.alias("words")), "bloom-level")


def _accepts(words: Column, key: Column, level: int, bits: int, hashes: int) -> Column:
    accepted = F.lit(True)
    for at in _positions(key, level, bits, hashes):
        accepted = accepted & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return accepted


def cascade(keys: DataFrame, others: int) -> list[tuple[DataFrame, int, int]]:
    """Levels over ``keys`` (``key``, ``is_listed``), each as its written filter, bits and hashes; none if nothing is listed."""
    encode, refuse = keys.where("is_listed").select("key"), keys.where(~F.col("is_listed")).select("key")
    levels = []
    count = encode.count()
    rate = min(FIRST_RATE, max(count, 1) / (math.sqrt(2) * max(others, 1)))
    while count:
        number = len(levels)
        bits, hashes = _bits(count, rate)
        words = _encoded(encode, number, bits, hashes)
        levels.append((words, bits, hashes))
        wrong = stored(refuse.where(_accepts(words.scalar(), F.col("key"), number, bits, hashes)), "bloom-wrong")
        encode, refuse, rate = wrong, encode, RATE
        count = wrong.count()
    return levels


def _is_member(levels: list[tuple[DataFrame, int, int]], key: Column) -> Column:
    member = F.lit(len(levels) % 2 == 1)
    for number, (words, bits, hashes) in reversed(list(enumerate(levels))):
        member = F.when(_accepts(words.scalar(), key, number, bits, hashes), member).otherwise(F.lit(number % 2 == 1))
    return member


def with_membership(rows: DataFrame, key: Column, listed: DataFrame, to: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``rows`` with the boolean column ``to``: whether ``key`` is among the first column of ``listed``."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    corpus = rows.select(key.alias("key"), F.lit(False).alias("is_listed"), F.lit(True).alias("is_used"))
    given = listed.select(F.col(f"`{listed.columns[0]}`").cast("string").alias("key"), F.lit(True).alias("is_listed"), F.lit(False).alias("is_used"))
    keys = corpus.unionByName(given.where(F.col("key").isNotNull())).groupBy("key").agg(
        F.max("is_listed").alias("is_listed"), F.max("is_used").alias("is_used"))
    keys = stored(keys.where("is_used").select("key", "is_listed"), "url-keys")
    count, others = keys.agg(F.count_if("is_listed"), F.count_if(~F.col("is_listed"))).first()
    rate = min(FIRST_RATE, max(count, 1) / (math.sqrt(2) * max(others, 1)))
    shards = max(1, math.ceil(_bits(count, rate)[0] / 8 / filter_bytes))
    if shards == 1:
        return rows.withColumn(to, _is_member(cascade(keys, others), key))
    shard = lambda k: F.pmod(F.xxhash64(F.lit("shard"), k), F.lit(shards))
    parts = None
    for number in range(shards):
        levels = cascade(keys.where(shard(F.col("key")) == number), others // shards)
        part = rows.where(shard(key) == number).withColumn(to, _is_member(levels, key))
        parts = part if parts is None else parts.unionByName(part)
    return parts


ADDED = ("url_host", "url_path", "url_rule", "url_verdict")


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``pages`` (``url``) with the columns ``ADDED``, which replace columns of these names.

    A verdict is the winning rule's, else block for listed hosts and allow for the rest.
    """
    plain = [c for c in pages.columns if c.lower() not in (*ADDED, "url_is_listed")]
    url = F.col("url")
    named = pages.select(*[F.col(f"`{c}`") for c in plain], host_of(url).alias("url_host"), path_of(url).alias("url_path"))
    found = with_membership(named, F.col("url_host"), listed, "url_is_listed", filter_bytes)
    rule = fitting_rule(F.col("url_host"), F.col("url_path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("url_is_listed"), "block").otherwise("allow"))
    return found.select(*[F.col(f"`{c}`") for c in plain], F.coalesce("url_host", F.lit("")).alias("url_host"),
                        F.coalesce("url_path", F.lit("")).alias("url_path"), rule["rule"].alias("url_rule"), verdict.alias("url_verdict"))


def hosts_with_words(pages: DataFrame, words: Sequence[str] = WORDS) -> DataFrame:
    """The distinct hosts that have one of the words between dots and hyphens."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    return hosts.where(F.col("host").rlike(rf"(^|[.-])({'|'.join(words)})($|[.-])"))


def op13_url_filter(spark, folder: str) -> DataFrame:
    """Every page's URL judged by the fixed rules and a list of hosts."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judged(pages, hosts_with_words(pages)).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP13_SQL = f"""
WITH cut AS (
  SELECT page_id, COALESCE(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(number, verdict, rule) AS (VALUES {", ".join(f"({n}, '{v}', '{r}')" for n, (v, r) in enumerate(RULES))}),
fitting AS (
  SELECT page_id, rule, verdict FROM named JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, number) = 1)
SELECT n.page_id, host, path, rule,
       COALESCE(f.verdict, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(WORDS)})($|[.-])') THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fitting f USING (page_id)
"""
