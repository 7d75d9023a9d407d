"""Movies as tables bucketed and sorted by pixel.

Wavelengths, masks and region weights that are bucketed alike meet without an exchange; partial sums and facts of
recordings are all that travels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PIXEL = ("measu", "x", "y")


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Rows with measu, x and y as the table ``name`` in ``path``: one sorted file for each of ``buckets``.

    A recording is spread over all buckets, so a hot one is no hot bucket. Give every table of a movie the same number.
    """
    placed = rows.repartition(buckets, *PIXEL).sortWithinPartitions(*PIXEL)
    placed.write.mode("overwrite").bucketBy(buckets, *PIXEL).sortBy(*PIXEL).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, columns: str, buckets: int) -> DataFrame:
    """A table written by :func:`write_bucketed` in another session; ``columns`` is its schema as DDL."""
    by = ", ".join(PIXEL)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS"
    )
    return spark.table(name)
