"""Sequential work within groups, without a call into Python for each of many small groups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def per_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """work(key, rows) for each group, with its rows as tuples of df's columns in the given order; the rows that it returns.

    Rows are dealt by key and sorted within partitions by Spark, so a task streams through its groups and holds one at a time.
    """
    at = [df.columns.index(k) for k in keys]
    names = [f.name for f in StructType(_parse_datatype_string(schema).fields)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        for frame in frames:
            for row in zip(*(frame[c].tolist() for c in frame.columns), strict=True):
                this = tuple(row[i] for i in at)
                if this != key:
                    if rows:
                        out += work(key, rows)
                    key, rows = this, []
                rows.append(row)
            yield pd.DataFrame(out, columns=names)
            out = []
        if rows:
            yield pd.DataFrame(list(work(key, rows)), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the folder that all executors share."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows written in that folder as Parquet and read back: for what has many rows, as columns are packed and each reader takes its own. With `by`,
    a folder for each of its few values."""
    path = f"{shared_folder(df)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder of the application, below the one that is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/cairnledger-{os.getpid()}")
    return sc.getCheckpointDir()


def dealt_join(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows, which is dealt by key: its size after a cut of lineage or an explode is estimated far too low, and a
    broadcast would pass it through the driver."""
    return side.hint("merge")
