"""Helpers shared by the corpus operators: word rule, lineage cuts, slices of Arrow batches, row numbers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII control breaks (tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"

#: A small table may be broadcast when its counted rows do not exceed this.
BROADCAST_ROWS = 50_000


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered, as UTF-8: bytes.lower and bytes.split know ASCII only, as the rule does."""
    return text.encode().lower().split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set on the context, or in local
    mode a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = os.path.join(tempfile.gettempdir(), f"cairnledger-{os.getpid()}")
    return f"file://{here}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def own_folder(spark: SparkSession) -> str:
    """Where this application puts its intermediate tables."""
    return f"{shared_folder(spark)}/cairnledger/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables and checkpoints that operators of this application have written. Results that have not been read or written to
    their end can't be after this; call it when they have."""
    remove(spark, own_folder(spark))
    if held := spark.sparkContext.getCheckpointDir():  # the context's own folder below the one that was set
        remove(spark, held)
        spark.sparkContext.setCheckpointDir(held.rpartition("/")[0])


def as_table(df: DataFrame) -> DataFrame:
    """The same rows written as Parquet in the shared folder and read back: columnar, with statistics for the planner. They stay until
    clean() is called."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else Spark joins it as any other table."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """df with a 0-based number by a total order, from a range-partitioned sort.

    Only one count for each partition visits the driver, so no task ever holds all rows.
    """
    ordered = df.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__within"),
    )
    ordered = cut_lineage(ordered)
    counts = {r[0]: r[1] for r in ordered.groupBy("__part").count().collect()}
    start, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, start))
        start += counts[part]
    offset = ordered.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    return (
        ordered.join(F.broadcast(offset), "__part")
        .withColumn(name, F.col("__offset") + F.col("__within"))
        .drop("__part", "__within", "__offset")
    )


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches with about `most` bytes of text each (a longer text is a slice by itself)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
