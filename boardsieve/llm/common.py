"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: whole texts travel in them, so few rows keep a Python worker small.
BATCH_ROWS = 256

#: A table is broadcast up to this many rows and bytes of strings, and joined by shuffle beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

#: What the word rules call white space: blank and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, because a row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a plain local session, which is one process, may lack the setting; it then gets a
    temporary folder of its own.  A cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="boardsieve-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored; marked for broadcast only if its counted rows and bytes of strings are within the bound."""
    kept = stored(df, name)
    strings = [F.octet_length(F.col(f"`{f.name}`")) for f in kept.schema.fields if f.dataType.simpleString() == "string"]
    size = sum((F.coalesce(F.sum(s), F.lit(0)) for s in strings), F.lit(0))
    rows, length = kept.agg(F.count("*"), size).first()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and length <= BROADCAST_BYTES else kept


def spare(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so: helper columns never meet those of a caller."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def grouped(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 16384) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys`` joined into frames that hold whole groups, ``rows`` or more rows if there are."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        last = batch[keys].iloc[-1]
        if count < rows or (batch[keys].iloc[0] == last).all():
            continue
        cut = int((batch[keys] == last).all(axis=1).to_numpy().argmax())  # where the last group of the batch starts
        yield pd.concat([*held[:-1], batch.iloc[:cut]], ignore_index=True)
        held = [batch.iloc[cut:]]
        count = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)
