"""What several operators share: words, folders for intermediate tables, bounded joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.plans.skew import join_per_key

#: A word is a run of characters that are none of these.
SPACES = " \t\n\x0b\x0c\r"
#: Rows up to which a per-key table is broadcast; a row is one short key and a few numbers.
BROADCAST_ROWS = 10_000
#: Texts that a Python task handles at once.
SLICE_ROWS = 500


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    r"""Runs of ``[^\x20\x09-\x0D]`` in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task makes of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data; an own one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumentrace-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and there after an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def join_facts(big: DataFrame, facts: DataFrame, rows: int, keys: Sequence[str], how: str = "left", estimated: bool = True) -> DataFrame:
    """Join one-row-per-key facts: broadcast up to BROADCAST_ROWS counted rows, else by salted keys.

    ``estimated=False`` merges them there, as Catalyst's estimate of a packed table would let its copies per salt be broadcast.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(facts), list(keys), how)
    return join_per_key(big, facts, keys, how, estimated=estimated)
