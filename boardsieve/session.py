"""Session settings the operators rely on, and the shared checkpoint folder."""

import tempfile

from pyspark.sql import SparkSession

_SQL_CONF = {
    # Payload times are UTC; every window and age is computed in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A list of up to this many keys reaches Parquet as a list, not as a range, so that Bloom filters can test it.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # Long texts go to Python in small batches; 10,000 of them at once take hundreds of MB on either side.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # A generated method over 8000 bytes is never JIT-compiled; above that the
    # per-operator code, which Spark splits into small methods, is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session and return it."""
    for key, value in _SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names; only a local session may lack one."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="boardsieve-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current
