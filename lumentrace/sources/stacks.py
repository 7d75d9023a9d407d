"""Frame stacks: binary ingest, axis order, wavelength and recording splits, casts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumentrace.plans.skew import join_per_key


def decode_stacks(jobs: DataFrame, rows_per_batch: int = 4096) -> DataFrame:
    """Rows ``(measu, width, height, frames, content)`` of flat 16-bit stacks to traces.

    Values are little-endian, x fastest, then y, then frame; y is turned upside down. Pixels
    are turned into traces ``rows_per_batch`` at a time.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for measu, nx, ny, nt, content in batch.itertuples(index=False):
                if len(content) < 2 * nx * ny * nt:
                    raise ValueError(f"recording {measu}: {2 * nx * ny * nt} bytes expected, {len(content)} found")
                values = np.frombuffer(content, dtype="<u2", count=nx * ny * nt).reshape(nt, ny, nx)[:, ::-1, :]
                per_pixel = values.reshape(nt, ny * nx).T
                y, x = np.divmod(np.arange(ny * nx), nx)
                for i in range(0, ny * nx, rows_per_batch):
                    cut = slice(i, i + rows_per_batch)
                    yield pd.DataFrame(
                        {"measu": measu, "x": x[cut], "y": y[cut], "trace": list(per_pixel[cut].astype(float))}
                    )

    return jobs.select("measu", "width", "height", "frames", "content").mapInPandas(decode, "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>")


def read_stacks(spark: SparkSession, path: str, geometry: DataFrame, rows_per_batch: int = 4096) -> DataFrame:
    """Flat 16-bit stacks to traces, all files of a folder in one job.

    ``geometry(stem, measu, width, height, frames)`` comes from `read_geometry`. A file is
    the unit of work and must fit one row (2 GB); :func:`read_stack_ranges` has no such bound.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ps*").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)\.pst?$", 1)
    return decode_stacks(files.select(stem.alias("stem"), "content").join(geometry, "stem"), rows_per_batch)


class StackRanges(DataSource):
    """Flat 16-bit stacks of a folder, read by ranges of frames: ``spark.read.format("stack_ranges").load(folder)``.

    Every file is cut into byte ranges of about ``bytes`` (default 64 MB), whatever its size; a task reads the sidecar
    beside the file, seeks to the frames that begin in its range and reads no others. Rows hold stem, x, y, the
    first frame ``t0`` and the values of the range, ``block`` pixels at a time. Files are opened through
    Arrow's file systems (local, HDFS, S3 and others).
    """

    @classmethod
    def name(cls) -> str:
        return "stack_ranges"

    def schema(self) -> str:
        return "stem STRING, x INT, y INT, t0 INT, frames INT, part ARRAY<DOUBLE>"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _RangeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.step = int(options.get("bytes", 1 << 26))
        self.block = int(options.get("block", 4096))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.folder)
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.extension in ("pst", "ps")]
        return [_Range(f.path, start, start + self.step) for f in found for start in range(0, max(f.size, 1), self.step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        base = partition.path.rsplit(".", 1)[0]
        with system.open_input_stream(f"{base}.inf") as sidecar:
            nx, ny, nt = sidecar_geometry(sidecar.read().decode())
        frame = 2 * nx * ny
        first, last = -(-partition.start // frame), min(-(-partition.end // frame), nt)
        stem = base.rsplit("/", 1)[-1]
        if system.get_file_info(partition.path).size < frame * nt:
            raise ValueError(f"{stem}: {frame * nt} bytes expected")
        if first >= last:
            return
        with system.open_input_file(partition.path) as file:
            file.seek(first * frame)
            values = np.frombuffer(file.read((last - first) * frame), "<u2").reshape(last - first, ny, nx)[:, ::-1, :]
        per_pixel = values.reshape(last - first, ny * nx).T
        y, x = np.divmod(np.arange(ny * nx, dtype=np.int32), nx)
        for i in range(0, ny * nx, self.block):
            part = per_pixel[i : i + self.block].astype(float)
            n = len(part)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * (last - first))
            columns = [pa.array([stem] * n), pa.array(x[i : i + n], pa.int32()), pa.array(y[i : i + n], pa.int32()), pa.array([first] * n, pa.int32()),
                       pa.array([nt] * n, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["stem", "x", "y", "t0", "frames", "part"])


def sidecar_geometry(text: str) -> tuple[int, int, int]:
    """Width, height and frames of a sidecar's ``key=value`` lines."""
    facts = dict(line.split("=") for line in text.splitlines() if line.count("=") == 1)
    held = {k.strip(): v.strip() for k, v in facts.items()}
    return int(held["Width"]), int(held["Height"]), int(held["Frames"])


def read_stack_ranges(spark: SparkSession, path: str, recordings: DataFrame, **options: int) -> DataFrame:
    """Flat 16-bit stacks of any size to traces; a large file is read by many tasks (:class:`StackRanges`).

    ``recordings(stem, measu)`` names the recording of each file. The ranges of a pixel are joined in one shuffle, and
    an incomplete trace is an error.
    """
    spark.dataSource.register(StackRanges)
    parts = spark.read.format("stack_ranges").options(**{k: str(v) for k, v in options.items()}).load(path)
    named = parts.join(recordings.select("stem", "measu"), "stem")
    pieces = F.array_sort(F.collect_list(F.struct("t0", "part")))
    traces = named.groupBy("measu", "x", "y").agg(F.flatten(pieces["part"]).alias("trace"), F.max("frames").alias("n"))
    lost = F.raise_error(F.concat(F.lit("incomplete trace of recording "), F.col("measu").cast("string"))).cast("array<double>")
    return traces.select("measu", "x", "y", F.when(F.size("trace") == F.col("n"), F.col("trace")).otherwise(lost).alias("trace"))


def read_geometry(spark: SparkSession, path: str, recordings: DataFrame) -> DataFrame:
    """Width, height and frames of sidecar ``key=value`` files.

    ``recordings(stem, measu)`` names the recording of each file.
    """
    texts = spark.read.option("pathGlobFilter", "*.inf").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.size(F.split(s, "=")) == 2)
    facts = F.map_from_entries(
        F.transform(lines, lambda s: F.struct(F.trim(F.get(F.split(s, "="), F.lit(0))), F.trim(F.get(F.split(s, "="), F.lit(1)))))
    )
    parsed = texts.select(F.regexp_extract("file", r"([^/]+?)\.inf$", 1).alias("stem"), facts.alias("m"))
    sizes = parsed.select(
        "stem",
        *[F.col("m")[k].cast("int").alias(n) for k, n in (("Width", "width"), ("Height", "height"), ("Frames", "frames"))],
    )
    return sizes.join(recordings, "stem")


def axes_normalised(rows: DataFrame, ny: int, swapped: bool = True) -> DataFrame:
    """row/column order to x/y with y turned upside down.

    Input columns ``row`` and ``column``; ``swapped=False`` means row is x already.
    """
    x, y = ("column", "row") if swapped else ("row", "column")
    return rows.withColumns({"x": F.col(x), "y": ny - 1 - F.col(y)}).drop("row", "column")


def lifted(frames: DataFrame) -> DataFrame:
    """A single frame as a movie of one frame."""
    return frames if "t" in frames.columns else frames.withColumn("t", F.lit(0))


def split_wavelengths(stack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interleaved channels ``w``: 1 is the first wavelength (340), 0 the second (380)."""
    return stack.filter(F.col("w") == 1).drop("w"), stack.filter(F.col("w") == 0).drop("w")


def paired_channels(stack: DataFrame) -> DataFrame:
    """S13 in one pass: both channels of a pixel side by side."""
    keys = [c for c in stack.columns if c not in ("w", "v")]
    return stack.groupBy(*keys).agg(
        F.max(F.when(F.col("w") == 1, F.col("v"))).alias("v1"), F.max(F.when(F.col("w") == 0, F.col("v"))).alias("v2")
    )


def cut_series(frames: DataFrame, duration: int, key: str = "series", time: str = "t") -> DataFrame:
    """One long series to recordings of ``duration`` frames."""
    return frames.withColumns(
        {"measu": F.floor(F.col(time) / duration).cast("long"), time: (F.col(time) % duration).cast("int")}
    )


def check_series(frames: DataFrame, stimuli: DataFrame, duration: int, key: str = "series") -> DataFrame:
    """Per series, whether frames = stimuli x duration. ``stimuli(series, n_stim)``."""
    counted = frames.groupBy(key).agg(F.max("t").alias("__last"))
    return counted.join(stimuli, key).select(key, (F.col("__last") + 1 == F.col("n_stim") * duration).alias("complete"))


# Ranges of the integer types a stack may be written in.
RANGES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767)}


def cast_to_range(pixels: DataFrame, dtype: str, scale: bool, groups: list[str] | None = None) -> DataFrame:
    """Values as whole numbers of a type: as they are when every value of a movie
    fits exactly, else stretched from its minimum..maximum, else an error."""
    low, high = RANGES[dtype]
    groups = groups or ["measu"]
    exact = (F.col("v") == F.floor("v")) & F.col("v").between(low, high)
    facts = pixels.groupBy(*groups).agg(F.min("v").alias("__a"), F.max("v").alias("__b"), F.bool_and(exact).alias("__fit"))
    joined = join_per_key(pixels, facts, groups)
    stretched = low + F.try_divide((F.col("v") - F.col("__a")), F.col("__b") - F.col("__a")) * (high - low)
    otherwise = stretched if scale else F.raise_error(F.lit(f"values do not fit into {dtype}; allow scaling")).cast("double")
    return joined.withColumn("v", F.when(F.col("__fit"), F.col("v")).otherwise(otherwise).cast("int")).drop("__a", "__b", "__fit")
