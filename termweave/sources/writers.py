"""Sinks that verify what they wrote."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> int:
    """Rows that are there after the write, from the files' footers."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite", expected: int | None = None) -> int:
    """Rows of the table after the write; raises if others than expected (default, when overwriting: those of df) are there."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.format(fmt).mode(mode).saveAsTable(name)
    if expected is None and mode == "overwrite":
        expected = seen.get["n"]  # counted while the rows were written
    there = df.sparkSession.table(name).count()
    if expected is not None and there != expected:
        raise ValueError(f"{name}: {expected} rows expected, {there} there")
    return there


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def metadata_json(metadata: dict, strict: bool = False) -> str:
    """Metadata for a side file; values that JSON lacks become text, or raise."""
    return json.dumps(metadata, sort_keys=True, default=None if strict else str)


def require_tables(spark: SparkSession, tables: dict[str, int]) -> None:
    """Raises unless each table exists with so many rows at least; looks at no more rows than that."""
    for name, least in tables.items():
        if not spark.catalog.tableExists(name):
            raise ValueError(f"no table {name}")
        if spark.table(name).limit(least).count() < least:
            raise ValueError(f"{name} has fewer than {least} rows")
