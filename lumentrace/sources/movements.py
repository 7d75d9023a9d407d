"""Movement lists: three rows per recording (x, y, quality), one column per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A


def parse_movement_rows(rows: DataFrame) -> DataFrame:
    """Text rows to shifts. ``rows(line_no, value)``: recording, row kind, channel,
    then one number per frame. Of several blocks of a recording the last one counts."""
    cells = F.transform(F.split("value", "\t"), lambda v: v.try_cast("double").cast("int"))
    parsed = rows.select("line_no", cells.alias("c"))
    parsed = parsed.select(
        "line_no", F.col("c")[0].cast("long").alias("measu"), F.col("c")[1].alias("kind"), F.slice("c", 4, F.size("c")).alias("values")
    )
    last = parsed.groupBy("measu", "kind").agg(F.max_by("values", "line_no").alias("values"))
    points = A.unrolled(last, "measu", "kind", trace="values")
    kinds = {0: "dx", 1: "dy", 2: "quality"}
    return points.groupBy("measu", "t").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(name) for k, name in kinds.items()]
    )


def movement_rows(shifts: DataFrame) -> DataFrame:
    """Shifts to text rows. A row holds one recording's frames."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("v")) for k, c in enumerate(("dx", "dy", "quality"))]
    )
    long = shifts.select("measu", "t", F.explode(kinds).alias("k")).select("measu", "t", "k.kind", "k.v")
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))["v"]
    joined = long.groupBy("measu", "kind").agg(ordered.alias("v"))
    return joined.select(
        "measu", "kind", F.concat_ws("\t", F.col("measu").cast("string"), F.col("kind").cast("string"), F.lit("0"), F.array_join("v", "\t")).alias("value")
    )


def append_shifts(shifts: DataFrame, path: str) -> None:
    """Append to a movement list."""
    movement_rows(shifts).select("value").write.mode("append").text(path)


def read_shifts(spark: SparkSession, path: str) -> DataFrame:
    """Read a movement list. Later files and later lines of a file win."""
    text = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    order = F.struct("file_modification_time", "file_block_start", "id").alias("line_no")
    return parse_movement_rows(text.select("value", order))
