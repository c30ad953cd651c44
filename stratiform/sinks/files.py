"""Parquet, CSV and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

BOM = "﻿"
SINGLE_FILE_ROWS = 1_000_000


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "snappy") -> None:
    """Partitioned folders are written with few files each; a large partition is still split."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(
    df: DataFrame,
    path: str,
    sep: str = ";",
    bom: bool = False,
    encoding: str = "utf-8",
    single_file: bool = False,
    max_rows: int = SINGLE_FILE_ROWS,
) -> None:
    """CSV with a header. ``bom`` marks UTF-8 for spreadsheets.

    ``single_file`` is for small results: above ``max_rows`` it raises, so that no large
    table goes through one task.
    """
    if single_file:
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"more than {max_rows} rows: write several files instead")
        df = df.coalesce(1)
    if bom:
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    (
        df.write.mode("overwrite")
        .option("header", "true")
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_report(df: DataFrame, path: str) -> bool:
    """A comma-separated report of any length, in as many files as it has partitions; nothing without a row."""
    if df.isEmpty():
        return False
    write_csv(df, path, sep=",")
    return True
