"""Row-wise operators on a streaming source.

Movies are finished files, so there is no stateful stream work here. What a recorder
writes continuously can still be turned into signals as it arrives, because signal and
feature expressions touch one row at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.model import TRACES, Params
from lumentrace.operators.signals import relative_change


def traces_stream(spark: SparkSession, path: str) -> DataFrame:
    """Traces that arrive as parquet files in a folder."""
    return spark.readStream.schema(TRACES).parquet(path)


def dff_stream(traces: DataFrame, params: Params) -> DataFrame:
    """Relative change with the default background range, on a stream or a table."""
    low, high = params.default_background
    return traces.withColumn("trace", relative_change("trace", F.lit(low), F.lit(high)))
