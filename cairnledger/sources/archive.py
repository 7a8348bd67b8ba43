"""Backup and restore of a ledger: a folder of JSON lines for each table, and a manifest with row counts and schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VERSION = 1


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes every table and, last, the manifest; a folder without a manifest is no backup."""
    if not tables:
        raise ValueError("nothing to back up")
    entries = []
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/{name}")
        entries.append((name, df.schema.json(), df.sparkSession.read.schema(df.schema).json(f"{folder}/{name}").count(), VERSION))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(entries, "name string, schema string, n_rows long, version int").coalesce(1).write.json(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> dict[str, tuple[StructType, int]]:
    rows = spark.read.schema("name string, schema string, n_rows long, version int").json(f"{folder}/manifest").collect()
    if any(r["version"] > VERSION for r in rows):
        raise ValueError("the backup is of a later version")
    return {r["name"]: (StructType.fromJson(json.loads(r["schema"])), r["n_rows"]) for r in rows}


def restore(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None, force: bool = False) -> dict[str, DataFrame]:
    """The tables of a backup, typed, with their row counts checked; refused beside a ledger that has rows, unless forced."""
    if not force and any(not df.isEmpty() for df in (held or {}).values()):
        raise ValueError("the ledger is not empty")
    out = {}
    for name, (schema, n) in manifest(spark, folder).items():
        out[name] = spark.read.schema(schema).json(f"{folder}/{name}")
        if (found := out[name].count()) != n:
            raise ValueError(f"{name} has {found} rows of {n}")
    return out
