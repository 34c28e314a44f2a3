"""Vectorised Python functions that can be defined before a session exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that Spark hands to a Python worker.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession | None) -> None:
    """Tells a session to hand Python workers batches of about ``BATCH_BYTES``: 10000 rows of texts otherwise take tens of MB, and several
    times that as Python's objects, for each core. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def vectorised(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            bounded(SparkSession.getActiveSession())
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap
