"""Region-trace tables as semicolon text with one column per frame.

In a table the frames are one array column ``frames`` of equal length; only a line of text
has a cell per frame, so neither plans nor schemas grow with the length of a movie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.operators.gdm import cleaned_line, padded

# The marker before the frames and the columns that stand last before it.
MARKER = "Trace begins->"
LAST_COLUMNS = ("StimONms", "StimLen", "Odour", "Stimulus", "OConc", "Cycle", "GloTag", "Measu", "Animal", "PlaceHolder")
SEPARATOR = ";"


def to_wide(table: DataFrame) -> DataFrame:
    """Marker, ten columns moved to the end, then all frames; shorter traces end in nulls."""
    columns = [*[c for c in table.columns if c != "trace"], "PlaceHolder"]
    ordered = [c for c in columns if c not in LAST_COLUMNS] + [c for c in LAST_COLUMNS if c in columns]
    return table.withColumn("PlaceHolder", F.lit(MARKER)).select(*ordered, padded(table).alias("frames"))


def from_wide(wide: DataFrame) -> DataFrame:
    """A wide table to metadata columns and a trace of ``NumFrames`` values."""
    meta = [c for c in wide.columns if c not in ("frames", "PlaceHolder")]
    numbers = F.col("frames").cast("array<double>")
    table = wide.select(*meta, F.slice(numbers, F.lit(1), F.col("NumFrames").cast("int")).alias("trace"))
    return cleaned_line(table) if "line" in meta else table


def metadata_only(wide: DataFrame) -> DataFrame:
    """The columns before ``PlaceHolder``; frames are never parsed."""
    meta = wide.select(*[c for c in wide.columns if c not in ("frames", "PlaceHolder")])
    return cleaned_line(meta) if "line" in meta.columns else meta


def wide_lines(wide: DataFrame) -> Column:
    """A line of text per row; a cell may not hold the separator."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wide.columns if c != "frames"]
    return F.array_join(F.concat(F.array(*cells), F.col("frames").cast("array<string>")), SEPARATOR, "")


def parse_wide(lines: DataFrame, header: Sequence[str], text: str = "value") -> DataFrame:
    """Lines to a wide table; ``header`` has the cells of the first line of the file."""
    at = header.index("PlaceHolder")
    cells = F.split(text, SEPARATOR)
    named = [F.nullif(F.get(F.col("__c"), F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(header[: at + 1])]
    rest = F.slice(F.col("__c"), F.lit(at + 2), F.size("__c"))
    empty_as_null = F.transform(rest, lambda x: F.nullif(x, F.lit("")))
    return lines.select(cells.alias("__c")).select(*named, empty_as_null.alias("frames"))


def write_gdm(table: DataFrame, path: str) -> None:
    """S7 to text files, each with the header line."""
    wide = to_wide(table)
    longest = table.agg(F.coalesce(F.max(F.size("trace")), F.lit(0))).first()[0]
    header = [*[c for c in wide.columns if c != "frames"], *[f"Frame{i}" for i in range(longest)]]
    lines = wide.select(wide_lines(wide).alias(SEPARATOR.join(header)))
    # one column whose name is the header line, written as it is
    lines.write.mode("overwrite").option("sep", "\u0001").option("quote", "").option("header", True).csv(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    is_header = F.array_contains(F.split("value", SEPARATOR), "PlaceHolder")
    header = lines.filter(is_header).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    return parse_wide(lines.filter(~is_header), header["value"].split(SEPARATOR))


def read_gdm(spark: SparkSession, path: str) -> DataFrame:
    """S5 from files."""
    return from_wide(_read(spark, path))


def read_gdm_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S6 from files."""
    return metadata_only(_read(spark, path))
