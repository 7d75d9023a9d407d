"""Per-animal export of processed data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.plans.skew import facts_in_use, join_per_key


def processed_rows(metadata: DataFrame, overview: DataFrame, signal: DataFrame, ny: int) -> DataFrame:
    """Metadata, response value and signal trace of every pixel, y turned upside down.

    A nested row per pixel stands for the cells of the former array file, so no movie is
    ever gathered in one row. ``metadata(measu, animal, ...)``, ``overview(measu, x, y, value)``.
    """
    pixels = signal.join(overview.select("measu", "x", "y", F.col("value").alias("response")).hint("merge"), ["measu", "x", "y"])
    joined = join_per_key(pixels, facts_in_use(metadata, signal, ["measu"]), ["measu"], spread=["x", "y"])
    others = [c for c in metadata.columns if c not in ("measu", "animal")]
    return joined.select(
        "animal", "measu", F.struct(*others).alias("metadata"), "x", (ny - 1 - F.col("y")).alias("y"), "response", "trace"
    )


def export_processed(rows: DataFrame, path: str) -> None:
    """Nested parquet, a folder per animal."""
    rows.write.mode("overwrite").partitionBy("animal").parquet(path)
