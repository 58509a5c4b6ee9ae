"""Landed responses: gate, per-board dedup, union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from boardsieve.functions import fixed_values as v
from boardsieve.functions.pin import pinned
from boardsieve.functions.text import has_any
from boardsieve.operators.dedup import keep_first
from boardsieve.schema import LANDED, POSTING

# What a board's gate looks at beyond the status.
LOGIN_BOARDS = ("linkedin",)
LOGIN_STATUS = (301, 302, 403)
LONG_BODY_BOARDS = ("techjobsforgood", "eurobrussels", "goodjobs")
BLOCK_PAGE_BOARDS = ("techjobsforgood",)

# A row's sequence packs batch, board rank, response and place in it, high to low.  Where a board's responses need more
# bits in a batch, its places get fewer.
_POS_BITS, _REQUEST_BITS, _BOARD_BITS = 20, 20, 5


def gate_label(source: Column, status: Column, body: Column) -> Column:
    """Why a response of a board is unusable; 'ok' otherwise."""
    low = F.lower(body)
    login = source.isin(*LOGIN_BOARDS) & (
        status.isin(*LOGIN_STATUS) | F.coalesce(F.contains(F.substring(low, 1, 500), F.lit("login")), F.lit(False)))
    return (
        F.when(status == 429, "rate_limited")
        .when(login, "login")
        .when(F.coalesce(status != 200, F.lit(True)), "http_error")
        .when(source.isin(*LONG_BODY_BOARDS) & (F.length(F.coalesce(body, F.lit(""))) < v.HTML_MIN_CHARS), "too_short")
        .when(source.isin(*BLOCK_PAGE_BOARDS) & has_any(low, v.TECHJOBS_BLOCK_PHRASES), "blocked")
        .otherwise("ok")
    )


def usable(landed: DataFrame, source: str) -> DataFrame:
    """Usable responses of one board; the source filter prunes partitions."""
    rows = landed.filter(F.col("source") == source)
    return rows.filter(gate_label(F.lit(source), F.col("status"), F.col("body")) == "ok")


CORRUPT = "_corrupt_record"


def write_landed(landed: DataFrame, path: str, form: str = "parquet") -> None:
    """Append responses to a landed table, a folder per board."""
    landed.write.mode("append").partitionBy("source").format(form).save(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """A landed table; boards that are not asked for are folders that are not read."""
    return spark.read.schema(LANDED).parquet(path)


def of_boards(landed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Responses of the boards that another table names in its column ``source``.

    That table has a row per board at most, so it is broadcast, and what it holds prunes the folders at run time.
    """
    names = wanted.select("source").distinct().filter(F.col("source").isin(*v.BOARDS))
    return landed.join(F.broadcast(names), "source", "left_semi")


def landed_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The JSON-lines files of a landed table as a stream; a line that is no response keeps its text in ``CORRUPT``."""
    reader = spark.readStream.schema(StructType([*LANDED.fields, StructField(CORRUPT, StringType())])).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def rejected_responses(landed: DataFrame) -> DataFrame:
    """Responses no adapter reads, with the reason."""
    label = gate_label(F.col("source"), F.col("status"), F.col("body"))
    if CORRUPT in landed.columns:
        label = F.when(F.col(CORRUPT).isNotNull(), "corrupt").otherwise(label)
    return landed.select("source", "request_key", "request_seq", label.alias("reason")).filter(F.col("reason") != "ok")


def item_order() -> list[Column]:
    """Feed order of an item: its response, then its place in it."""
    return [F.col("request_seq").asc(), F.col("pos").asc()]


def dedup_items(items: DataFrame, key: str) -> DataFrame:
    """First item per key in feed order.  On native ids this runs before the required fields are
    looked at, so a first copy that lacks one hides a good second one; on urls after it.

    Items that have a reason already are refused ones: all of them stay and hide nothing.
    """
    return keep_first(items, _item_keys(items, key), item_order())


def _item_keys(items: DataFrame, key: str) -> list[Column]:
    keys = [F.col(key)]
    if "reason" in items.columns:
        keys.append(F.when(F.col("reason").isNotNull(), F.struct("request_seq", "pos")))
    return keys


#: Responses with later copies up to which their places are broadcast.
MAX_BROADCAST_RESPONSES = 2_000_000


def dedup_wide_items(items: DataFrame, key: str, max_broadcast: int | None = None) -> DataFrame:
    """``dedup_items`` for items with whole descriptions, which don't move.

    Keys and places are ranked first; the places of later copies, listed by response, go to where the
    items are.  Beyond the bound, or if items can't be told apart by their place, whole items are ranked.
    """
    narrow = items.select(*dict.fromkeys(["request_seq", "pos", key, *[c for c in items.columns if c == "reason"]]))
    keys = _item_keys(narrow, key)
    window = Window.partitionBy(*keys).orderBy(*item_order())
    # The hash tells items of a repeated response apart.
    place = F.shiftleft(F.col("pos").cast("long"), 32) + F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    ranked = narrow.select("request_seq", place.alias("place"), F.row_number().over(window).alias("n"), F.rank().over(window).alias("rank"))
    later = ranked.filter("n > 1").groupBy(F.col("request_seq").alias("of_request")).agg(
        F.collect_list("place").alias("later"), F.count_if((F.col("rank") == 1) | F.col("request_seq").isNull() | F.col("place").isNull()).alias("ties"))
    later = pinned(later)
    responses, ties = later.agg(F.count(F.lit(1)), F.coalesce(F.sum("ties"), F.lit(0))).first()
    if ties or responses > (MAX_BROADCAST_RESPONSES if max_broadcast is None else max_broadcast):
        return dedup_items(items, key)
    met = items.join(F.broadcast(later.drop("ties")), F.col("request_seq") == F.col("of_request"), "left")
    return met.filter(~F.coalesce(F.array_contains("later", place), F.lit(False))).select(*items.columns)


def keep_items(items: DataFrame, condition: Column) -> DataFrame:
    """Items a board's own rule wants; refused ones stay with their reason."""
    return items.filter(F.col("reason").isNotNull() | condition)


def _packed(name: str, bits: int) -> Column:
    """A part of the sequence; a value that doesn't fit its bits is an error, never cut."""
    value = F.col(name).cast("long")
    wrong = value.isNull() | (value < 0) | (value >= (1 << bits))
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"{name} does not fit {bits} bits: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("long")).otherwise(value)


def place_bits(last_request: int | None) -> int:
    """Bits of a place beside responses numbered up to this one: 20, or what the responses leave of 40."""
    return max(0, min(_POS_BITS, _REQUEST_BITS + _POS_BITS - (last_request or 0).bit_length()))


def feed_seq(source: str, last_request: int | None = None) -> Column:
    """Sequence of an item within a batch: board rank, then response, then place; fixed by the input alone."""
    rank, low = F.lit(v.BOARDS.index(source)).cast("long"), place_bits(last_request)
    request = _packed("request_seq", _REQUEST_BITS + _POS_BITS - low)
    return F.shiftleft(rank, _REQUEST_BITS + _POS_BITS) + F.shiftleft(request, low) + _packed("pos", low)


def resequenced(items: DataFrame) -> DataFrame:
    """Items of several boards with their sequence anew, its places as narrow as the responses of a board ask for."""
    valid = F.col("reason").isNull()
    last = items.filter(valid).groupBy("source").agg(F.max("request_seq")).collect()  # a row per board
    seq = F.lit(None).cast("long")
    for name, last_request in last:
        seq = F.when(valid & (F.col("source") == name), feed_seq(name, last_request)).otherwise(seq)
    return items.withColumn("ingest_seq", seq)


def batch_seq(seq: Column, batch_id: int) -> Column:
    """The sequence of a row over all batches."""
    if not 0 <= batch_id < 1 << (63 - _BOARD_BITS - _REQUEST_BITS - _POS_BITS):
        raise ValueError(f"batch id {batch_id} does not fit the sequence")
    return F.shiftleft(F.lit(batch_id).cast("long"), _BOARD_BITS + _REQUEST_BITS + _POS_BITS) + seq


def to_posting(df: DataFrame) -> DataFrame:
    """Complete columns to the posting schema, nulls where there are none."""
    columns = []
    for field in POSTING.fields:
        known = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(known.cast(field.dataType).alias(field.name))
    return df.select(*columns)


# What every item carries from the response to the end of its adapter.
CARRIED = ("request_seq", "pos", "fetched_at", "source", "reason")
# What tells where a refused item stood and why it is refused.
REFUSAL = ("request_seq", "pos", "reason", "field")


def to_items(df: DataFrame) -> DataFrame:
    """All items of a board in posting form with ``REFUSAL``; the sequence is still to come."""
    columns = [F.col("request_seq").cast("long").alias("request_seq"), F.col("pos").cast("long").alias("pos"), "reason", "field"]
    for field in POSTING.fields:
        known = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(known.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def kept(items: DataFrame) -> DataFrame:
    """The valid items of a board as postings."""
    return to_posting(items.filter(F.col("reason").isNull()))


def refused(items: DataFrame) -> DataFrame:
    """The other ones, as rows of the reject log; a body that could not be read has no place."""
    return items.filter(F.col("reason").isNotNull()).select("source", *REFUSAL)


def adapter(parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A board: called, it gives its postings; ``items`` gives valid and refused items from one parse, valid ones with their sequence.

    ``last_request`` is the largest number of its responses, known where they may be more than 2^20.
    """
    def items(landed: DataFrame, last_request: int | None = None) -> DataFrame:
        return parse(landed).withColumn("ingest_seq", F.when(F.col("reason").isNull(), feed_seq(parse.__name__, last_request)))

    @wraps(parse)
    def board(landed: DataFrame) -> DataFrame:
        return kept(items(landed))

    board.items = items
    return board


def union_boards(parts: dict[str, DataFrame]) -> DataFrame:
    """All boards in registry order; columns a board lacks become null."""
    ordered = [parts[name] for name in v.BOARDS if name in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)


def selected_boards(name: str | None = None) -> tuple[str, ...]:
    """One board by name or all of them; an unknown name is an error."""
    if name is None:
        return v.BOARDS
    if name not in v.BOARDS:
        raise ValueError(f"unknown board {name!r}; available: {', '.join(v.BOARDS)}")
    return (name,)
