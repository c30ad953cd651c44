"""Catalog tables: names, overwrite, append."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("bronze", "silver", "gold")
_NAME = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*")


def validate_table_name(name: str, project: str | None = None) -> str:
    """``[catalog.]<layer>.<project>_<description>``: lower case, digits and ``_`` only."""
    parts = name.split(".")
    if len(parts) not in (2, 3) or not all(_NAME.fullmatch(part) for part in parts):
        raise ValueError(f"{name!r} is not [catalog.]layer.table in lower case, digits and underscores")
    if parts[-2] not in LAYERS:
        raise ValueError(f"{name!r}: layer must be one of {LAYERS}")
    if project and parts[-1] != project and not parts[-1].startswith(f"{project}_"):
        raise ValueError(f"{name!r}: table must start with {project}_")
    return name


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def _writer(df: DataFrame, mode: str, path: str | None, partition_by: Sequence[str]):
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format("parquet").mode(mode).option("compression", "snappy")
    if path:
        writer = writer.option("path", path)
    return writer.partitionBy(*partition_by) if partition_by else writer


def overwrite_table(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rebuild the table in full and return it as written."""
    _writer(df, "overwrite", path, partition_by).saveAsTable(name)
    return df.sparkSession.table(name)


def align(df: DataFrame, columns: Sequence[tuple[str, str]], strict: bool = True) -> DataFrame:
    """The target's columns in order and type: missing ones null, extra ones refused or dropped."""
    extra = [name for name in df.columns if name not in dict(columns)]
    if extra and strict:
        raise ValueError(f"columns the target does not have: {extra}")
    return df.select(
        [
            (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in columns
        ]
    )


def append_table(df: DataFrame, name: str, strict: bool = True) -> DataFrame:
    spark = df.sparkSession
    align(df, spark.table(name).dtypes, strict).write.format("parquet").mode("append").saveAsTable(name)
    return spark.table(name)
