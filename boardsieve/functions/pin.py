"""Pin what several readers need: derived columns in a plan, rows in the shared folder."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.session import ensure_checkpoint_dir


def pinned(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder, because several branches read them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def pinned_wide(df: DataFrame) -> DataFrame:
    """The same for rows with long texts: compressed columns, of which a reader takes the ones it asks for."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/wide-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def evaluate_once(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once, whatever is filtered on them afterwards.

    A filter on a derived column is normally pushed below the projection, which
    repeats every rule expression it refers to.  A generator of exactly one row
    stops that, stays in the same stage and is compiled like a projection.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))
