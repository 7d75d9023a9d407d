"""Measurement lists and recording files without lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.model import meta_rows
from lumentrace.operators import measurements as L

#: Columns of the manifest of runs.
MANIFEST = "run_ts STRING, rows BIGINT"


def read_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab text in latin-1, blanks after the separator skipped, header right-trimmed."""
    df = (
        spark.read.option("sep", "\t").option("header", True).option("encoding", "ISO-8859-1")
        .option("ignoreLeadingWhiteSpace", True).csv(path)
    )
    return df.toDF(*[c.rstrip() for c in df.columns])


def parse_list(lines: DataFrame, header: str, text: str = "value") -> DataFrame:
    """S1 for lines of text: cells by the names of a header line, blanks after a separator skipped."""
    names = [c.strip() for c in header.split("\t")]
    schema = ", ".join(f"`{n}` STRING" for n in names)
    options = {"sep": "\t", "ignoreLeadingWhiteSpace": "true"}
    return lines.select(F.from_csv(F.col(text), F.lit(schema), options).alias("__r")).select("__r.*")


def list_lines(df: DataFrame) -> Column:
    """A list's rows as tab text."""
    return F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), "\t")


def ordered_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen columns first and in order, all others behind them."""
    return df.select(*[c for c in columns if c in df.columns], *[c for c in df.columns if c not in columns])


def write_list(df: DataFrame, path: str, columns: Sequence[str], old: DataFrame | None = None, keep_old: Sequence[str] = ()) -> None:
    """Write a list; chosen columns of an older list win."""
    if old is not None:
        df = L.merged_old_values(df, old, keep_old, key="Measu")
    out = ordered_columns(df, columns)
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("encoding", "ISO-8859-1").csv(path)


def write_list_by_animal(df: DataFrame, path: str) -> None:
    """S2 for many animals at once: columnar, one folder per animal."""
    df.write.mode("overwrite").partitionBy("animal").parquet(path)


def convert_list(spark: SparkSession, source: str, target: str, from_names: str, to_names: str) -> None:
    """S3: the same list under another naming scheme."""
    df = L.renamed(read_list(spark, source), from_names, to_names)
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(target)


def combined(parts: Sequence[DataFrame], keep: Column | None = None) -> DataFrame:
    """Metadata of many recordings in one list; ``keep`` is the recording filter."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.filter(keep) if keep is not None else out


def versioned(df: DataFrame, run_ts: str) -> DataFrame:
    """Rows of one run; written with `write_versioned`, older runs stay."""
    return df.withColumn("run_ts", F.lit(run_ts))


def write_versioned(df: DataFrame, path: str, run_ts: str) -> None:
    """A new folder per run instead of overwriting; an entry in the manifest, written last, makes the run visible.

    What an interrupted run with the same time has left is replaced; a complete run is never written again.
    """
    spark = df.sparkSession
    if _manifest(spark, path).filter(F.col("run_ts") == run_ts).limit(1).count():
        raise ValueError(f"run {run_ts} is complete already")
    folder = f"{path}/runs/{run_ts}"
    df.write.mode("overwrite").parquet(folder)
    _enter(spark, path, run_ts, spark.read.schema(df.schema).parquet(folder).count())


def _enter(spark: SparkSession, path: str, run_ts: str, rows: int) -> None:
    entry = spark.createDataFrame([(run_ts, rows)], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Complete runs and their row counts; empty before the first one."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest complete run, with ``run_ts``."""
    newest = _manifest(spark, path).agg(F.max("run_ts")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no complete run in {path}")
    return versioned(spark.read.parquet(f"{path}/runs/{newest}"), newest)


def newest_complete(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """S19 for rows of many runs in one table: those of the newest run that the manifest has, with the number of rows it names."""
    present = runs.groupBy("run_ts").agg(F.count(F.lit(1)).alias("rows"))
    complete = present.join(manifest, ["run_ts", "rows"], "left_semi").agg(F.max("run_ts")).scalar()
    return runs.filter(F.col("run_ts") == complete)


def column_docs(columns: DataFrame, docs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``columns(position, column)`` with their descriptions, then extra texts.

    ``docs(column, description)``, ``extra(position, description)``.
    """
    lines = columns.join(docs, "column", "left").select("position", "column", "description")
    if extra is not None:
        top = columns.agg(F.max("position")).scalar()
        more = extra.select(
            (F.col("position") + top).alias("position"), F.lit(None).cast("string").alias("column"), "description"
        )
        lines = lines.unionByName(more)
    return lines.withColumn(
        "line", F.concat(F.lit("Column "), F.col("position").cast("string"), F.lit(": "), F.col("description"))
    )


# Extensions and wavelengths of the data files of a setup.
SETUPS = {
    3: ("pst", 1),
    4: ("pst", 2),
    20: ("lsm", 1),
    21: ("lif", 1),
    32: ("txt", 1),
    33: ("tif", 1),
    34: ("tif", 2),
    35: ("tif", 2),
    665: ("synthetic", 1),
    666: ("synthetic", 1),
    667: ("synthetic", 1),
    676: ("synthetic", 1),
}


def setup_source(setup: int) -> tuple[str, int]:
    """File kind and number of wavelengths of a setup id."""
    try:
        return SETUPS[setup]
    except KeyError:
        raise NotImplementedError(f"no setup {setup}") from None


def chosen_files(measurements: DataFrame, listing: DataFrame, setup: int, root: str, fallback: str = "tif") -> DataFrame:
    """The data file of every recording; the default format stands in when the
    expected file is missing."""
    kind, _channels = setup_source(setup)
    return L.first_existing(measurements, listing, "measu", [f".{kind}", f".{fallback}"], root)


def without_list(files: DataFrame, sampling_rate: Column | float) -> DataFrame:
    """Recordings known by file only: label from the name, period from the rate, the
    rest by default. ``files(path)``."""
    from lumentrace.functions.text import animal_of_path

    named = files.select("path").distinct().select(
        F.col("path").alias("DBB1"),
        animal_of_path("path").alias("Label"),
        (F.lit(1000.0) / (sampling_rate if isinstance(sampling_rate, Column) else F.lit(float(sampling_rate)))).alias("Cycle"),
    )
    return L.with_defaults(named).select(*[r[0] for r in meta_rows()])


def parse_protocols(texts: DataFrame) -> DataFrame:
    """``key : value`` protocols, one row per entry of ``Stimuli``.

    ``texts(file, value)`` holds whole files. Cycle = 1000 / FPS, label = Animal_Trial. A
    value is all that follows the first colon of its line.
    """
    # Text pairs are read by hand: keys and values may carry blanks around the colon.
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: s.contains(":"))
    pairs = F.transform(
        lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v"))
    )
    facts = texts.select("file", F.map_from_entries(pairs).alias("m"))
    stimuli = F.transform(F.split(F.col("m")["Stimuli"], ","), lambda s: F.trim(s))
    rows = facts.select("file", "m", F.posexplode(stimuli).alias("measu", "stimulus"))
    return rows.select(
        "file",
        "measu",
        "stimulus",
        (F.lit(1000.0) / F.col("m")["FPS"].cast("double")).alias("cycle"),
        F.concat_ws("_", F.col("m")["Animal"], F.col("m")["Trial"]).alias("label"),
        F.col("m")["Duration"].cast("int").alias("n_frames"),
        F.lit(-1).alias("analyze"),
        F.lit("0").alias("lambda_nm"),
    )


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """S23 from files; a protocol is a page of text, so a file is one row."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_protocols(texts)
