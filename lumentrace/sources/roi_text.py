"""Region text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.plans.skew import join_per_key


def parse_roi_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """``circle label x y d`` and ``polygon label x1 y1 ...``, tab separated.

    Any other line is an error. Keeps the other columns of ``lines``.
    """
    parts = F.split(F.regexp_replace(text, r"\n$", ""), "\t")
    kind = F.when(F.col(text).startswith("circle"), "circle").when(F.col(text).startswith("polygon"), "polygon")
    numbers = F.transform(F.slice(F.col("__p"), 3, F.size("__p")), lambda v: v.cast("double"))
    circle = F.col("kind") == "circle"
    pairs = F.sequence(F.lit(0), F.floor(F.size("__n") / 2).cast("int") - 1)
    vertices = F.transform(
        pairs, lambda k: F.struct(F.get("__n", 2 * k).alias("x"), F.get("__n", 2 * k + 1).alias("y"))
    )
    parsed = lines.withColumn("__p", parts).withColumn(
        "kind", F.coalesce(kind, F.raise_error(F.concat(F.lit("not a region line: "), F.col(text))))
    )
    parsed = parsed.withColumn("__n", numbers)
    return parsed.select(
        *[c for c in lines.columns if c != text],
        F.get("__p", F.lit(1)).alias("roi"),
        "kind",
        *[F.when(circle, F.get("__n", F.lit(i))).alias(c) for i, c in enumerate(("cx", "cy", "d"))],
        F.when(~circle, vertices).alias("vertices"),
        F.col(text).alias("description"),
    )


def read_roi_text(spark: SparkSession, path: str) -> DataFrame:
    """S8 from files; the file path tells regions of different files apart."""
    return parse_roi_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def roi_lines(shapes: DataFrame) -> Column:
    """One line per region with two decimals."""

    def two(c: Column) -> Column:
        return F.format_string("%.2f", c)

    corners = F.flatten(
        F.transform(
            "vertices",
            lambda p: F.array(two(F.bround(p["x"]).cast("double")), two(F.bround(p["y"]).cast("double"))),
        )
    )
    circle = F.array_join(F.array(F.lit("circle"), F.col("roi"), two(F.col("cx")), two(F.col("cy")), two(F.col("d"))), "\t")
    polygon = F.array_join(F.concat(F.array(F.lit("polygon"), F.col("roi")), corners), "\t")
    return F.when(F.col("kind") == "circle", circle).otherwise(polygon)


def write_roi_text(shapes: DataFrame, path: str) -> None:
    """S9 to text files."""
    shapes.select(roi_lines(shapes).alias("value")).write.mode("overwrite").text(path)


def parse_coor_lines(lines: DataFrame) -> DataFrame:
    """Line 0 of a file is the count n, the next n lines are ``x y label``; fewer
    lines are an error. ``lines(file, line_no, value)``."""
    facts = lines.groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 0, F.trim("value"))).cast("int").alias("__n"),
        (F.count(F.lit(1)) - 1).alias("__have"),
    )
    enough = F.when(F.col("__have") >= F.col("__n"), F.col("__n")).otherwise(
        F.raise_error(F.lit("coordinate file has fewer lines than its count")).cast("int")
    )
    body = join_per_key(lines, facts.select("file", enough.alias("__n")), ["file"])
    parts = F.split("value", "\t")
    return body.filter((F.col("line_no") > 0) & (F.col("line_no") <= F.col("__n"))).select(
        "file",
        F.ltrim(F.get(parts, F.lit(2))).alias("roi"),
        F.trim(F.get(parts, F.lit(0))).cast("int").alias("cx"),
        F.trim(F.get(parts, F.lit(1))).cast("int").alias("cy"),
        (F.col("line_no") - 1).cast("int").alias("roi_idx"),
    )


def read_coor(spark: SparkSession, path: str) -> DataFrame:
    """S10 from files: a coordinate file is small, so its lines are numbered in one row."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("line_no", "value"))
    return parse_coor_lines(lines)
