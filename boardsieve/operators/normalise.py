"""Record rules: strip, tag coercion, ids, required fields, scope defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions.text import lookup, strip
from boardsieve.settings import RuleSet

REQUIRED = ("title", "company", "location", "url", "source")


def posting_id(url: Column) -> Column:
    """Surrogate key: SHA-256 of the url."""
    return F.sha2(url, 256)


def content_hash(title: Column, company: Column, location: Column) -> Column:
    """Cross-url key: SHA-256 of lower-cased, stripped title|company|location."""
    return F.sha2(F.concat_ws("|", *[strip(F.lower(x)) for x in (title, company, location)]), 256)


def company_key(company: Column) -> Column:
    """Key of the per-company cap and of the company blocklist."""
    return strip(F.lower(company))


def split_tags(csv: Column) -> Column:
    """Comma-separated text to a tag list; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ",", -1), strip)
    return F.filter(parts, lambda t: t != "")


def join_tags(tags: Column) -> Column:
    """Tag list to the stored text form."""
    return F.array_join(tags, ",")


def finish(df: DataFrame) -> DataFrame:
    """Strip title and company, then derive both keys of every posting."""
    stripped = df.withColumns({"title": strip(F.col("title")), "company": strip(F.col("company"))})
    return stripped.withColumns({
        "id": posting_id(F.col("url")),
        "content_hash": content_hash(F.col("title"), F.col("company"), F.col("location")),
    })


def missing_field(df: DataFrame) -> Column:
    """Name of the first required field that is null, null for a valid row."""
    return F.coalesce(*[F.when(F.col(name).isNull(), F.lit(name)) for name in REQUIRED])


def with_reason(df: DataFrame) -> DataFrame:
    """Add ``field``, the first required field an item lacks, and ``reason``, null for a valid item.

    An item that could not be read at all comes with the reason ``malformed`` and keeps it.
    """
    read = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    named = df.withColumn("field", F.when(read.isNull(), missing_field(df)))
    return named.withColumn("reason", F.coalesce(read, F.when(F.col("field").isNotNull(), "missing")))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows a typed record would refuse, with the field that failed."""
    return df.withColumn("missing", missing_field(df)).filter(F.col("missing").isNotNull())


def default_scope(scope: Column, source: Column, rules: RuleSet) -> Column:
    """Board-specific default where classification ended in 'unknown'."""
    return F.when(scope == "unknown", F.coalesce(lookup(dict(rules.scope_defaults), source), scope)).otherwise(scope)
