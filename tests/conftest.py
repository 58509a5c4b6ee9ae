import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("boardsieve-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from boardsieve import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Postings from partial dictionaries, missing fields filled with plain values."""
    from datetime import datetime

    from pyspark.sql import types as T

    from boardsieve.operators.normalise import finish
    from boardsieve.schema import POSTING

    schema = T.StructType([f for f in POSTING.fields if f.name not in ("id", "content_hash")])

    def build(*rows):
        filled = []
        for i, row in enumerate(rows):
            base = dict(title="Software Engineer", company="Acme Corp", location="Remote", is_remote=True, remote_scope=None,
                        url=f"https://example.com/job/{i}", description=None, salary=None, tags=[], source="test", is_ngo=False,
                        match_score=0, posted_at=None, fetched_at=datetime(2026, 3, 23, 8, 0), ingest_seq=i)
            base.update(row)
            filled.append(tuple(base.get(f.name) for f in schema.fields))
        return finish(spark.createDataFrame(filled, schema))

    return build
