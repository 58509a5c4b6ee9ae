"""Secret scans with corpus-wide ownership frequency, DataFrame operations only.

Base findings are matched by three patterns, leftmost and not overlapping within a kind.  The
method looks at every candidate value, those of the base findings and other long mixed
tokens, and counts by value digest in how many distinct repositories and with how many
distinct owners it occurs.  A value that more than ``MAX_OWNERS`` owners hold is a copied
example; one that fewer hold looks live.  Other tokens that look live are added as findings
of kind ``owned``; base findings stay in any case and are only classified.

Counts are combined before each shuffle (value and owner first, then value), so a value that
a third of all rows hold is a few rows per task.  Findings return to their document by key.

Defined cases: a null text is empty and has no findings; null owners count as one owner; rows
that repeat a doc_id are told apart by their text, and equal rows share their findings; columns besides the
named ones are not looked at, whatever they are called, and only those of ``ADDED`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import spare, stored, table, text_or_empty

# Fixed values of the contract: patterns of the base findings by kind, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Other tokens the method looks at: long, with a letter and a digit, of many distinct characters.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
TOKEN_DISTINCT = 10

KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS = 2
MASK = "[SECRET]"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """All matches as structs of kind, start, end (code points) and value.

    The matches and the pieces between them come from one pattern each; start and end are
    running sums of their lengths.  The sums are only built for texts that match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(matches.alias("m"), F.slice(pieces, F.lit(1), F.size(matches)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.length(pair["p"])
        end = begin + F.length(pair["m"])
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda done: done["found"])).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The contract's findings; an assignment counts if its value is long enough."""
    assign = F.filter(spans_of(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return F.concat(assign, spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex"))


def token_spans(text: Column) -> Column:
    """Other candidate tokens."""
    return F.filter(spans_of(text, TOKEN, "owned"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
                    & (F.size(F.array_distinct(F.split(s["value"], ""))) >= TOKEN_DISTINCT))


def _value(span: Column) -> Column:
    """The secret of a finding: the value of an assignment, else the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def _ordered(spans: Column) -> Column:
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def scan(docs: DataFrame, repository: Column, owner: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per (``doc_id``, ``text_key``) of ``docs``: ``base``, ``live`` and ``examples``.

    ``base`` holds the base findings; ``live`` and ``examples`` hold base findings and tokens
    by how many distinct owners their value has.  A token inside a base finding is left out.
    """
    text = text_or_empty(F.col("text"))
    found = docs.select("doc_id", F.md5(text).alias("text_key"), repository.alias("repository"), owner.alias("owner"),
                        base_spans(text).alias("base"), token_spans(text).alias("tokens"))
    other = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    found = stored(found.where((F.size("base") > 0) | (F.size("tokens") > 0)).withColumn("tokens", other), "secret-findings")
    values = found.select("doc_id", "text_key", "repository", "owner", F.explode(F.concat("base", "tokens")).alias("span")).withColumn(
        "digest", F.sha2(_value(F.col("span")), 256))
    owners = values.groupBy("digest", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner")).agg(F.lit(1).alias("one")).groupBy(
        "digest").agg(F.count("one").alias("owners"))
    repositories = values.groupBy("digest", F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("repository")).agg(
        F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias("repositories"))
    rated = values.join(owners, "digest").join(repositories, "digest").withColumn("is_live", F.col("owners") <= max_owners)
    rows = rated.select("doc_id", "text_key", F.struct("span.kind", "span.start", "span.end", "repositories", "owners").alias("finding"), "is_live")
    by_row = rows.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.collect_set(F.when(F.col("is_live"), F.col("finding"))).alias("live"), F.collect_set(F.when(~F.col("is_live"), F.col("finding"))).alias("examples"))
    plain = found.select("doc_id", "text_key", "base").groupBy("doc_id", "text_key").agg(F.first("base").alias("base"))
    return plain.join(by_row, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))).drop("of_id", "of_key")


ADDED = ("secret_base", "secret_live", "secret_examples")


def with_findings(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with the columns ``ADDED``, null where there are none; columns of these names are replaced."""
    docs = docs.drop(*ADDED)
    id_name, key_name = spare(docs.columns, "secret_id"), spare(docs.columns, "secret_key")
    renamed = findings.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name), F.col("base").alias("secret_base"),
                              F.col("live").alias("secret_live"), F.col("examples").alias("secret_examples"))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.md5(text_or_empty(F.col("text"))) == F.col(key_name))
    return docs.join(renamed, same, "left").drop(id_name, key_name)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every run of overlapping spans replaced by ``MASK``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        fresh = F.concat(done["out"], F.substring(text, done["at"] + 1, span["start"] - done["at"]), F.lit(MASK))
        return F.struct(F.when((span["start"] >= done["at"]) & ((span["start"] > 0) | (done["out"] == "")), fresh).otherwise(done["out"]).alias("out"),
                        F.greatest(done["at"], span["end"]).alias("at"))

    return F.aggregate(ordered, begin, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def op4_secret_scan(spark, folder: str) -> DataFrame:
    """Findings of every document; a document is a repository, its source the owner."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    findings = scan(docs, F.col("doc_id"), F.col("source"))
    narrow = docs.select("doc_id", F.md5(text_or_empty(F.col("text"))).alias("key"))
    renamed = findings.select(F.col("doc_id").alias("of_id"), "text_key", "base", "live", "examples")
    rows = narrow.join(renamed, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("text_key")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    plain = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), none)
    base, live, examples = plain(F.col("base")), plain(F.col("live")), plain(F.col("examples"))
    added = F.filter(live, lambda s: s["kind"] == "owned")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(base, "assign").alias("n_assign"), count(base, "access").alias("n_access"), count(base, "hex").alias("n_hex"),
                       F.sha2(F.array_join(_ordered(base), ","), 256).alias("base_sha256"),
                       F.array_join(_ordered(F.concat(base, added)), ",").alias("spans"),
                       F.size(live).cast("long").alias("n_live"), F.size(examples).cast("long").alias("n_examples"))


def _sql_spans(kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, text, source, '{kind}' AS kind, unnest(m) AS value,
       unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda s: length(s))) +
              COALESCE(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0)))::BIGINT AS start
  FROM (SELECT doc_id, text, source, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS p FROM documents)
  WHERE len(m) > 0"""


_SQL_ASSIGN = ASSIGN.replace("'", "''")
OP4_SQL = f"""
WITH raw AS (
  {_sql_spans("assign", _SQL_ASSIGN)}
  UNION ALL {_sql_spans("access", ACCESS)}
  UNION ALL {_sql_spans("hex", HEX)}
  UNION ALL {_sql_spans("owned", TOKEN)}),
spans AS (
  SELECT doc_id, text, source, kind, start, start + length(value) AS stop,
         CASE WHEN kind = 'assign' THEN regexp_extract(value, '{_SQL_ASSIGN}', 2) ELSE value END AS secret
  FROM raw),
kept AS (
  SELECT * FROM spans
  WHERE CASE kind WHEN 'assign' THEN length(secret) >= {ASSIGN_VALUE}
        WHEN 'owned' THEN regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]')
             AND len(list_distinct(string_split(secret, ''))) >= {TOKEN_DISTINCT}
        ELSE true END),
candidates AS (
  SELECT * FROM kept k
  WHERE kind <> 'owned' OR NOT EXISTS (
    SELECT 1 FROM kept b WHERE b.kind <> 'owned' AND b.doc_id = k.doc_id AND b.text = k.text AND b.start <= k.start AND k.stop <= b.stop)),
owners AS (SELECT secret, count(DISTINCT COALESCE(source, '')) <= {MAX_OWNERS} AS live FROM candidates GROUP BY secret),
rated AS (
  SELECT c.*, o.live, list_position(['assign', 'access', 'hex', 'owned'], kind) AS rank, kind || ':' || start || ':' || stop AS span
  FROM candidates c JOIN owners o USING (secret)),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base,
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned' OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples
  FROM rated GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0)::BIGINT AS n_assign, COALESCE(n_access, 0)::BIGINT AS n_access, COALESCE(n_hex, 0)::BIGINT AS n_hex,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans,
       COALESCE(n_live, 0)::BIGINT AS n_live, COALESCE(n_examples, 0)::BIGINT AS n_examples
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""
