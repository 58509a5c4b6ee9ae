"""Fixed schemas: postings, landed responses and the ledger's side logs."""

from pyspark.sql import types as T

POSTING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("is_remote", T.BooleanType()),
    T.StructField("remote_scope", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("is_ngo", T.BooleanType()),
    T.StructField("match_score", T.IntegerType()),
    T.StructField("company_city", T.StringType()),
    T.StructField("company_postal_code", T.StringType()),
    T.StructField("company_country", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("is_ngo_source", T.BooleanType()),
])

# One landed response: the fetcher writes these, the board adapters read them.
LANDED = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("request_key", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("request_seq", T.LongType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

NOTIFIED_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("notified_at", T.TimestampType()),
])

SCORE_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("scored_at", T.TimestampType()),
])

# Refused responses and items; ``pos`` is null for a whole response, ``field`` for what can't be read.
REJECT_LOG = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("request_key", T.StringType()),
    T.StructField("request_seq", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("field", T.StringType()),
    T.StructField("logged_at", T.TimestampType()),
])

SCAN_LOG = T.StructType([
    T.StructField("scan_id", T.LongType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("raw", T.LongType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("new", T.LongType()),
])
